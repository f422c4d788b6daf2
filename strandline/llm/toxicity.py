"""Operator 6: toxic spans by a linear-chain conditional random field.

Labels are of documents, so training tokens are labelled first: a word form (or beginning) that documents marked toxic
use far more than others, by a likelihood ratio, is toxic in such documents. A two-state chain with features of each
token's form, its beginning and the forms beside it, and transitions, is then fitted by gradient ascent on the exact conditional likelihood
(Lafferty et al. 2001). Forward-backward gives each token its marginal; a document's score is a logistic function of the
largest marginal and of their sum, and its offending offsets are runs of tokens above one half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import plus, table, tune
from strandline.llm.textkit import NOT_ALNUM, U64, mix, slices, window_hash, words_of

#: Labelled documents that the model is fitted on, of each label, by least hash of doc_id.
TRAINING_DOCS = 1500
#: Training documents that a form or beginning must be in to have a weight of its own; others share one.
LEAST_DOCS = 4
#: Bytes of text of a training document; longer ones are not trained on (all texts are scored whole).
TRAINING_BYTES = 20_000
#: Ridge of the weights of neighbouring forms.
CONTEXT_L2 = 1e-2
#: Bytes of a token's beginning.
HEAD = 5


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(form, beginning, first token of each row, start byte, end byte in the row's text) of a column's normalised words."""
    forms, heads, counts, starts, ends = [], [], [], [], []
    for _, _, data, bounds in slices(column):
        w = words_of(data, bounds, NOT_ALNUM, lower=True)
        h = words_of(data, bounds, NOT_ALNUM, lower=True, prefix=HEAD).h
        forms.append(w.h)
        heads.append(h)
        counts.append(np.diff(w.first))
        starts.append(w.start - bounds[w.doc])
        ends.append(w.end - bounds[w.doc])
    cat = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.empty(0, t)
    first = np.concatenate([[0], np.cumsum(cat(counts, np.int64))]).astype(np.int64)
    return cat(forms, np.uint64), cat(heads, np.uint64), first, cat(starts, np.int64), cat(ends, np.int64)


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log((t01 + t11 e^x) / (t00 + t10 e^x)): what a chain in log odds x says about the next token; t are exponentials."""
    e = np.exp(np.clip(x, -40, 40))
    return np.log((t[0, 1] + t[1, 1] * e) / (t[0, 0] + t[1, 0] * e))


def _memory(trans: np.ndarray) -> int:
    """Tokens after which a chain's start no longer shows in double precision (Birkhoff's contraction coefficient)."""
    tau = np.tanh(abs(trans[0, 0] + trans[1, 1] - trans[0, 1] - trans[1, 0]) / 4)
    return 1 if tau < 1e-9 else int(np.ceil(np.log(1e-18) / np.log(min(tau, 1 - 1e-9)))) + 1


def _recursion(u: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = 128) -> np.ndarray:
    """Log odds forward, each with its own token's. Long chains are cut into blocks that all take a step at once; a block
    starts so many tokens early that what came before has no effect in double precision."""
    warm = _memory(trans)
    block = max(block, warm)
    n = np.diff(first)
    cuts = -(-n // block)
    chain = np.repeat(np.arange(len(n)), cuts)
    if not len(chain):
        return u.copy()
    begin = first[:-1][chain] + block * (np.arange(len(chain)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    end = np.minimum(begin + block, first[1:][chain])
    early = np.maximum(begin - warm, first[:-1][chain])
    order = np.argsort(early - end, kind="stable")
    begin, end, early = begin[order], end[order], early[order]
    length = end - early
    out = np.empty(len(u))
    state, t = u[early], np.exp(trans)
    now = early == begin
    out[early[now]] = state[now]
    active = len(length) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1), side="left")
    for k in range(1, int(length[0])):
        m = active[k]
        at = early[:m] + k
        state = u[at] + _step(state[:m], t)
        now = at >= begin[:m]
        out[at[now]] = state[now]
    return out


def forward_backward(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, marginal) of chains first[d]:first[d + 1]: log odds forward with the token's own, backward without it."""
    a = _recursion(u, first, trans)
    turned = len(u) - first[::-1]
    b = _recursion(u[::-1], turned, trans.T)[::-1] - u
    return a, b, 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))


@dataclass
class Crf:
    #: Sorted hashes of known forms and beginnings, and their weights; the last weight is of all others. before and after
    #: are weights of the forms to the left and right of a token.
    forms: np.ndarray
    heads: np.ndarray
    form: np.ndarray
    head: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    trans: np.ndarray
    #: Intercept and weights of a document's largest marginal and of log(1 + their sum).
    out: np.ndarray

    def unary(self, f: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each token by itself, from the places of its form and beginning."""
        left, right = neighbours(f, first, len(self.forms))
        return self.bias + self.form[f] + self.head[h] + self.before[left] + self.after[right]

    def marginals(self, form: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(self.unary(places(self.forms, form), places(self.heads, head), first).astype(float), first, self.trans)[2]

    def scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = document_features(p, first) @ self.out
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def neighbours(f: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The values before and after each one in its chain; none at a chain's ends."""
    left, right = np.full(len(f), none), np.full(len(f), none)
    if len(f) > 1:
        left[1:], right[:-1] = f[:-1], f[1:]
        some = first[1:] > first[:-1]
        left[first[:-1][some]], right[first[1:][some] - 1] = none, none
    return left, right


def places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each value among the known ones, len(known) for others."""
    if not len(known):
        return np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[i] == x, i, len(known))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.zeros(len(first) - 1)
    np.maximum.at(top, np.repeat(np.arange(len(first) - 1), np.diff(first)), p)
    c = np.concatenate([[0.0], np.cumsum(p)])
    return np.stack([np.ones(len(top)), top, np.log1p(np.maximum(c[first[1:]] - c[first[:-1]], 0))], 1)


def _by_documents(key: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """(keys in LEAST_DOCS documents, those that documents marked toxic use far more than others: G2 above least, and
    hardly any others use them)."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    names, at, n = np.unique(k[new], return_inverse=True, return_counts=True)
    hits = np.bincount(at, toxic[d[new]], len(names))
    rate = min(max(toxic.mean(), 1e-6), 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(hits > 0, hits * np.log(hits / (n * rate)), 0) + np.where(n > hits, (n - hits) * np.log((n - hits) / (n * (1 - rate))), 0))
    return names[n >= LEAST_DOCS], names[(g > least) & (hits > 0.95 * n)]


def fit_crf(form: np.ndarray, head: np.ndarray, first: np.ndarray, toxic: np.ndarray, rounds: int = 40, l2: float = 1e-4) -> Crf:
    """The model of documents given as tokens with labels 0 or 1; without tokens, one that finds nothing. Adagrad on
    gradients over all of them, then Newton's method for the documents' scores; deterministic."""
    if not len(form):
        none = np.empty(0, np.uint64)
        return Crf(none, none, *np.zeros((4, 1)), -3.0, np.zeros((2, 2)), np.array([-3.0, 4.0, 1.0]))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    (forms, bad_forms), (heads, bad_heads) = _by_documents(form, doc, toxic), _by_documents(head, doc, toxic)
    y = toxic[doc] & (np.isin(form, bad_forms) | np.isin(head, bad_heads))
    f, h = places(forms, form), places(heads, head)
    wide = len(forms) + 1
    m = Crf(forms, heads, np.zeros(wide), np.zeros(len(heads) + 1), np.zeros(wide), np.zeros(wide), -3.0, np.zeros((2, 2)), np.array([-3.0, 4.0, 1.0]))
    left, right = neighbours(f, first, len(forms))
    memory = [np.full(len(m.form), 1e-6), np.full(len(m.head), 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(wide, 1e-6), np.full(wide, 1e-6)]
    inner = np.ones(len(f), bool)
    inner[first[1:][first[1:] > first[:-1]] - 1] = False  # a chain's last token has no successor in it
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
    for _ in range(rounds):
        u = m.unary(f, h, first)
        a, b, p = forward_backward(u, first, m.trans)
        r = y - p
        # pair marginals: proportional to alpha(s) e^T(s, s') psi(s') beta(s')
        e = np.exp(np.clip(a[i], -40, 40))
        x = np.exp(np.clip(u[i + 1] + b[i + 1], -40, 40))
        t = np.exp(m.trans)
        cells = [[t[0, 0] * np.ones(len(i)), t[0, 1] * x], [t[1, 0] * e, t[1, 1] * e * x]]
        z = sum(sum(c) for c in cells)
        expected = np.array([[(c / z).sum() for c in row] for row in cells])
        grads = [np.bincount(f, r, len(m.form)) - l2 * m.form, np.bincount(h, r, len(m.head)) - l2 * m.head, r.sum(), (seen - expected) - l2 * m.trans]
        # a neighbour tells less than the token itself, so its weights are held back more
        grads += [np.bincount(left, r, wide) - CONTEXT_L2 * m.before, np.bincount(right, r, wide) - CONTEXT_L2 * m.after]
        steps = []
        for k, g in enumerate(grads):
            memory[k] = memory[k] + g * g
            steps.append(0.5 * g / np.sqrt(memory[k]))
        m.form, m.head, m.bias, m.trans = m.form + steps[0], m.head + steps[1], float(m.bias + steps[2]), m.trans + steps[3]
        m.before, m.after = m.before + 0.2 * steps[4], m.after + 0.2 * steps[5]
        m.trans -= m.trans[0, 0]
    # calibration: logistic regression with a small ridge, by Newton's method
    x = document_features(m.marginals(form, head, first), first)
    w = np.array([-3.0, 4.0, 1.0]) if toxic.any() and not toxic.all() else m.out
    if toxic.any() and not toxic.all():
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (toxic - q) - 0.01 * w
            w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(3), g)
    m.out = w
    return m


def unlike(forms: list[np.ndarray], seeds: int = 6) -> list[int]:
    """Documents that share none of a few min-hashes of three-token runs with an earlier one: copies of one document
    would make its every word look like evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, f in enumerate(forms):
        g = window_hash(f, 3) if len(f) >= 3 else f
        mine = {(k, int(mix(g + U64(k * 0x51_7C_C1)).min())) for k in range(seeds)} if len(g) else {(0, 0)}
        if not mine & seen:
            out.append(i)
        seen |= mine
    return out


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAINING_DOCS) -> Crf:
    """Fits on at most limit toxic and 2 * limit other documents, none of them held out, of at most TRAINING_BYTES each.
    Null labels and keys don't count, nor keys with labels of both kinds; of texts with one key the least counts."""
    seen = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").drop("_most")
    by = F.xxhash64(F.lit(6), key)
    some = seen.filter("toxic = 1").orderBy(by, key).limit(limit).union(seen.filter("toxic = 0").orderBy(by, key).limit(2 * limit))

    def run(batches):
        for b in batches:
            form, head, first, _, _ = tokens(b.column(2))
            cut = lambda x: pa.array([x[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64()), cut(form), cut(head)], ["k", "toxic", "form", "head"])

    # 3 * limit rows at most: one for each key, before anything reaches the driver
    short = docs.select(key, text).filter(F.octet_length(text) <= TRAINING_BYTES).join(F.broadcast(some), key)
    one = short.groupBy(F.col(key).cast("string").alias("k")).agg(F.min("toxic").alias("toxic"), F.min(text).alias("t"))
    rows = one.mapInArrow(run, "k string, toxic bigint, form binary, head binary").toArrow()
    rows = rows.sort_by([("k", "ascending"), ("form", "ascending")])
    form, head = ([np.frombuffer(x, np.uint64) for x in rows.column(c).to_pylist()] for c in ("form", "head"))
    keep = unlike(form)
    form, head, rows = [form[i] for i in keep], [head[i] for i in keep], rows.take(pa.array(keep, pa.int64()))
    first = np.concatenate([[0], np.cumsum([len(x) for x in form])]).astype(np.int64)
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return fit_crf(cat(form), cat(head), first, rows.column("toxic").to_numpy() == 1)


def score(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5) and toxic_spans (start, end in code points, end exclusive).

    Null and empty texts have no tokens: the score of no evidence. Columns of these names are replaced, others stay; an
    empty table stays empty, repeated rows come out alike."""
    docs = docs.drop("score", "predicted", "toxic_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            form, head, first, start, end = tokens(b.column(text))
            p = m.marginals(form, head, first)
            s = m.scores(p, first)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                doc = np.searchsorted(first, hot, side="right") - 1
                for d in np.unique(doc):
                    raw = b.column(text)[int(d)].as_py().encode()
                    runs = hot[doc == d]
                    for r in np.split(runs, np.flatnonzero(np.diff(runs) > 1) + 1):
                        i, j = int(start[r[0]]), int(end[r[-1]])
                        lead = len(raw[:i].decode())
                        spans[d].append({"start": lead, "end": lead + len(raw[i:j].decode())})
            new = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "score", "predicted", "toxic_spans"])

    return docs.mapInArrow(run, plus(docs.schema, "score double, predicted int, toxic_spans array<struct<start:int,end:int>>"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("toxic_spans").alias("n_spans"))
