"""Operator 5: quality rules as a learned decision list.

Statistics of each text are columns. From a bounded sample of labelled rows, sequential covering (RIPPER's grow and
prune, Cohen 1995) learns conjunctions of thresholds that mark bad texts, each grown on two thirds of what is left and
pruned on the other third. The list comes out as ordered Spark conditional expressions over the statistics columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import plus, table, tune
from strandline.llm.textkit import slices, words_of

#: Labelled rows that a list is learned from, chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What thresholds may stand on.
FEATURES = ["f_words", "f_word_chars", "f_symbols", "f_dup_lines", "f_repeats", "f_distinct", "f_top_word", "f_short_lines", "f_digits", "f_upper", "f_stops"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def _counts(data: np.ndarray, mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics and features of a column of texts; null counts as empty."""
    parts: list[dict[str, np.ndarray]] = []
    for at, to, data, bounds in slices(column):
        w = words_of(data, bounds)
        docs = to - at
        n = np.diff(w.first)
        lead = (data & 0xC0) != 0x80
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=c[1:])
        chars = np.bincount(w.doc, c[w.end] - c[w.start], docs).astype(np.int64)
        # repeated five-word windows: equal (document, hash) neighbours after sorting
        g, same = w.grams(5)
        covered = np.zeros(len(w.h) + 1, np.int64)
        if same.any():
            i = np.flatnonzero(same)
            order = i[np.lexsort((g[i], w.doc[i]))]
            eq = (w.doc[order[1:]] == w.doc[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
            twice = np.zeros(len(order), bool)
            twice[1:] |= eq
            twice[:-1] |= eq
            s = order[twice]
            np.add.at(covered, s, 1)
            np.add.at(covered, s + 5, -1)
        rep = np.bincount(w.doc, np.cumsum(covered)[: len(w.h)] > 0, docs).astype(np.int64)
        order = np.lexsort((w.h, w.doc))
        d, h = w.doc[order], w.h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        runs = np.flatnonzero(new)
        top = np.zeros(docs, np.int64)
        np.maximum.at(top, d[runs], np.diff(np.append(runs, len(d))))
        distinct = np.bincount(d[runs], minlength=docs)
        lines, dups, short = np.zeros((3, docs), np.int64)
        whole = data.tobytes()
        for k in range(docs):
            seen = [x for x in whole[bounds[k] : bounds[k + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            lines[k], dups[k] = len(seen), len(seen) - len(set(seen))
            short[k] = sum(len(x) < 40 for x in seen)
        one = np.maximum(n, 1)
        all_chars = np.maximum(_counts(data, lead, bounds), 1)
        symbols = _counts(data, _SYMBOL[data], bounds)
        parts.append(
            {
                "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": rep,
                "f_words": n.astype(float), "f_word_chars": chars / one, "f_symbols": symbols / one, "f_dup_lines": dups / np.maximum(lines, 1), "f_repeats": rep / one,
                "f_distinct": distinct / one, "f_top_word": top / one, "f_short_lines": short / np.maximum(lines, 1),
                "f_digits": _counts(data, (data >= 48) & (data <= 57), bounds) / all_chars, "f_upper": _counts(data, (data >= 65) & (data <= 90), bounds) / all_chars, "f_stops": _counts(data, _STOPS[data], bounds) / one,
            }
        )
    names = [*BASE, *FEATURES]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in names}


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics (bigint) and features (double) of each text. Null and empty texts have zeros;
    columns of these names are replaced."""
    df = df.drop(*BASE, *FEATURES)
    schema = plus(df.schema, ", ".join([*(f"{c} bigint" for c in BASE), *(f"{c} double" for c in FEATURES)]))

    def run(batches):
        for b in batches:
            got = statistics(b.column(text))
            new = [pa.array(got[c].astype(np.int64)) for c in BASE] + [pa.array(got[c].astype(float)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *BASE, *FEATURES])

    return df.mapInArrow(run, schema)


@dataclass
class Rule:
    """A conjunction of (feature, is it >=, threshold); precision on the rows that pruned it."""

    terms: list[tuple[str, bool, float]]
    precision: float = 0.0
    covered: int = 0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, up, t in self.terms:
            out &= (x[name] >= t) if up else (x[name] <= t)
        return out

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, up, t in self.terms:
            out = out & ((F.col(name) >= F.lit(float(t))) if up else (F.col(name) <= F.lit(float(t))))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>=' if up else '<='} {t:.6g}" for n, up, t in self.terms)


@dataclass
class DecisionList:
    """Ordered rules, each marking bad texts; what no rule takes is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> F.Column:
        """0-based number of the first rule that holds, else null."""
        if not self.rules:
            return F.lit(None).cast("int")
        out = F.when(self.rules[0].column(), F.lit(0))
        for k, r in enumerate(self.rules[1:], 1):
            out = out.when(r.column(), F.lit(k))
        return out

    def kept(self) -> F.Column:
        return self.rule_number().isNull()

    def sql(self, column: str = "verdict") -> str:
        return "CASE " + " ".join(f"WHEN {r} THEN 'reject'" for r in self.rules) + f" ELSE 'keep' END AS {column}" if self.rules else f"'keep' AS {column}"


def _best_term(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, tuple[str, bool, float]] | None:
    """The threshold with most FOIL information gain over the rows."""
    p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), None
    for name in x:
        v = x[name][rows]
        order = np.argsort(v, kind="stable")
        v, y = v[order], bad[rows][order]
        cut = np.flatnonzero(v[1:] != v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        pos = np.cumsum(y)
        for up in (False, True):
            p = (p0 - pos[cut]) if up else pos[cut]
            n = (len(v) - cut - 1 - p) if up else (cut + 1 - p)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), (name, up, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.97, min_covered: int = 5, max_rules: int = 24, max_terms: int = 4, seed: int = 5) -> DecisionList:
    """Sequential covering: grow on two thirds, prune the last terms on one third, keep rules that are precise on both.

    No rows, or labels of one kind only: an empty list, which keeps everything."""
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    out = DecisionList()
    for _ in range(max_rules):
        if not bad[left].any():
            break
        left = rng.permutation(left)
        cut = len(left) * 2 // 3
        grow, prune = left[:cut], left[cut:]
        terms, rows = [], grow
        while len(terms) < max_terms and (best := _best_term(x, bad, rows)) and best[0] > 0:
            terms.append(best[1])
            name, up, t = best[1]
            rows = rows[(x[name][rows] >= t) if up else (x[name][rows] <= t)]
        if not terms:
            break
        best_rule, best_worth = None, -2.0
        for k in range(len(terms), 0, -1):
            rule = Rule(terms[:k])
            m = rule.mask({n: v[prune] for n, v in x.items()})
            p, n = int((m & bad[prune]).sum()), int((m & ~bad[prune]).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth >= best_worth:
                best_rule, best_worth, best_rule.precision, best_rule.covered = rule, worth, p / max(p + n, 1), p + n
        m = best_rule.mask({n: v[left] for n, v in x.items()})
        hit, good = int((m & bad[left]).sum()), int((m & ~bad[left]).sum())
        if hit < min_covered or hit < min_precision * (hit + good) or best_rule.precision < min_precision:
            break
        out.rules.append(best_rule)
        left = left[~m]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAINING_ROWS) -> DataFrame:
    """Statistics and `quality` of at most limit labelled rows, by least hash of the key. Rows whose label or key is null
    are left out, and so are keys with labels of both kinds; repeated labels count once."""
    some = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    some = some.orderBy(F.xxhash64(F.lit(5), key), key).limit(limit)
    # limit rows at most, so small enough to broadcast
    return with_statistics(docs.select(key, text).join(F.broadcast(some), key)).drop(text)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAINING_ROWS) -> DecisionList:
    """The list learned from labels.quality (0 is bad); see training_rows() and learn()."""
    rows = training_rows(docs, labels, key, text, limit).select("quality", *FEATURES, F.xxhash64(key).alias("h")).limit(limit).toPandas()
    rows = rows.sort_values(["h", *FEATURES], kind="stable")
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy() == 0)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule (number of the rule that took the text, else null) and kept. A null text
    has no words and so fails the base rule. An empty table stays empty, repeated rows are judged alike, other columns stay
    and those of these names are replaced."""
    out = with_statistics(docs, text).drop("base_failed", "rule", "kept")
    return out.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")
