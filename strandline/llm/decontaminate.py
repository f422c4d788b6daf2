"""Operator 8: benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words become numbers and all items go into one automaton. A document's words stream through it, each state
telling the longest item passage that ends here; at ten words and more the last ten are a window of some item, and an
item shorter than that counts when all of it has been read. States carry the items of their passages.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import dropped, plus, saved, table, tune
from strandline.llm.textkit import LOWER, NOT_ALNUM

#: Characters of items in one automaton (about 200 bytes of a worker's memory each). More items make more automata, and
#: the documents' texts are read for each in turn.
AUTOMATON_CHARS = 2_000_000
_TO = bytes(32 if NOT_ALNUM[b] else LOWER[b] for b in range(256))


def norm_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and any non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_TO).split() if text else []


class Automaton:
    """Generalised suffix automaton (Blumer et al. 1985) over the items' words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.names = [name for name, _ in items]
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        for seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shorts = sorted({len(s) for s in seqs if 0 < len(s) < window})
        self.least = min([window, *self.shorts])
        # the items of each state that stands for a window: its shortest passage is no longer than that, its longest no
        # shorter; a state is left for its link once that one holds the whole window too
        owners: dict[int, set[int]] = {}
        whole: dict[tuple[int, int], set[int]] = {}
        for k, seq in enumerate(seqs):
            s = 0
            for c in seq:
                s = self.next[s][c]
                while self.len[self.link[s]] >= window:
                    s = self.link[s]
                if self.len[s] >= window:
                    owners.setdefault(s, set()).add(k)
            if 0 < len(seq) < window:
                whole.setdefault((s, len(seq)), set()).add(k)
        # by state: the items hit when at least so many words match here: (words, items), most words first. What a state
        # shares with its link is one list, as most states have nothing of their own
        none: list[tuple[int, frozenset[int]]] = []
        self.hits = [none] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            low, high = self.len[self.link[v]], self.len[v]
            own = [(window, frozenset(owners[v]))] if v in owners else []
            own += [(n, frozenset(whole[v, n])) for n in reversed(self.shorts) if low < n <= high and (v, n) in whole]
            self.hits[v] = own + self.hits[self.link[v]] if own else self.hits[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Hit ranges of words (merged, ends exclusive), the items with occurring windows, the longest match."""
        got = list(map(self.vocab.get, words))
        spans: list[list[int]] = []
        items: set[int] = set()
        longest, i, n = 0, 0, len(got)
        nxt, link, length, hits = self.next, self.link, self.len, self.hits
        while i < n:
            if got[i] is None:
                i += 1
                continue
            # a run of known words; a shorter one than any window holds none
            j = i
            while j < n and got[j] is not None:
                j += 1
            if j - i >= self.least:
                s = m = 0
                for k in range(i, j):
                    c = got[k]
                    while s and c not in nxt[s]:
                        s = link[s]
                        m = length[s]
                    s = nxt[s].get(c, 0)
                    m = m + 1 if s else 0
                    if m > longest:
                        longest = m
                    if m >= self.least:
                        for need, who in hits[s]:
                            if m >= need:
                                items |= who
                                if spans and spans[-1][1] >= k + 1 - need:
                                    # windows of other lengths may reach further back than the last range
                                    while len(spans) > 1 and spans[-2][1] >= k + 1 - need:
                                        top = spans.pop()
                                        spans[-1][1] = top[1]
                                    spans[-1][0] = min(spans[-1][0], k + 1 - need)
                                    spans[-1][1] = k + 1
                                else:
                                    spans.append([k + 1 - need, k + 1])
            i = j
        return spans, items, longest


def build(items: list[tuple[str | None, list[bytes]]], window: int) -> bytes:
    """The automaton of (id, words) rows, packed; items without words are left out."""
    import zstandard

    held = sorted(((name, words) for name, words in items if words), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(Automaton(held, window), protocol=5))


_LAST: list = [None, None]


def opened(name: str, packed: bytes) -> Automaton:
    """The automaton of that name; a worker keeps the last one that it opened."""
    import zstandard

    if _LAST[0] != name:
        _LAST[:] = [None, None]
        _LAST[:] = [name, pickle.loads(zstandard.ZstdDecompressor().decompress(packed))]
    return _LAST[1]


def cut_item(words: list[bytes], chars: int, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(characters, words) of pieces of an item, of about chars characters at most: each begins with the last window - 1
    words of the one before, so that all of the item's windows are in one of them. An item of fewer words stays whole."""
    at = 0
    while True:
        size, end = 0, at
        while end < len(words) and (size < chars or end - at < 2 * window):
            size, end = size + len(words[end]) + 1, end + 1
        yield size, words[at:end]
        if end >= len(words):
            return
        at = end - window + 1


def automata(items: DataFrame, key: str = "item_id", text: str = "text", window: int = 10, chars: int = AUTOMATON_CHARS) -> Iterator[tuple[bytes, bool]]:
    """(packed automaton, is it the last) of parts of about chars characters of the items, at least one. Parts are built by
    executors and written to the shared folder; the driver holds one of them at a time.

    Items that repeat both id and text are one. They are dealt evenly, long ones are cut into pieces, and a task closes a
    part as soon as its pieces have chars characters: no part has more than about twice as many, whatever the items are."""
    once = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).distinct()
    total = once.agg(F.sum(F.char_length("t"))).first()[0] or 0

    def run(batches):
        from pyspark import TaskContext

        held: list[tuple[str | None, list[bytes]]] = []
        size, parts = 0, 0

        def closed() -> pa.RecordBatch:
            name = f"{TaskContext.get().partitionId():08d}-{parts:08d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([build(held, window)], pa.binary())], ["part", "automaton"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, words in cut_item(norm_words(t), chars, window):
                    held.append((k, words))
                    size += n
                    if size >= chars:
                        yield closed()
                        held, size, parts = [], 0, parts + 1
        if held:
            yield closed()

    made = saved(once.repartition(max(1, -(-int(total) // chars))).mapInArrow(run, "part string, automaton binary"))
    which = [r.part for r in made.select("part").orderBy("part").collect()]
    for part in which:
        yield made.filter(F.col("part") == part).first().automaton, part == which[-1]
    dropped(made)
    if not which:
        yield build([], window), True


_SPANS = "array<struct<start:int,end:int>>"


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """docs with n_words, hit_spans (word ranges inside windows), hit_items (sorted ids as text) and longest_match.

    Null, empty and wordless texts have no words and no hits. Columns of these names are replaced, all others stay;
    repeated rows are judged alike; an empty table stays empty. No items: no hits. Items with equal ids are one; those
    with a null id hit words as others do, but have no name to be listed by."""
    docs = docs.drop(*_FOUND)
    schema = plus(docs.schema, f"n_words bigint, hit_spans {_SPANS}, hit_items array<string>, longest_match int")
    made = automata(items, window=window, chars=chars)
    packed, last = next(made)
    if last:
        return docs.mapInArrow(_scanner(docs.sparkSession, packed, text, docs.columns), schema)
    return _in_turns(docs, packed, made, text)


#: What find_hits() adds.
_FOUND = ("n_words", "hit_spans", "hit_items", "longest_match")


def _scanner(spark: SparkSession, packed: bytes, text: str, rest: list[str], hits_only: bool = False) -> Callable:
    """A map over Arrow batches that adds what an automaton finds to the columns `rest`; hits_only: rows without hits go."""
    shared, name = spark.sparkContext.broadcast(packed), uuid.uuid4().hex

    def run(batches):
        a = opened(name, shared.value)
        for b in batches:
            rows, n, spans, names, longest = [], [], [], [], []
            for row, t in enumerate(b.column(text).to_pylist()):
                words = norm_words(t)
                hit, who, most = a.scan(words)
                if hits_only and not hit:
                    continue
                rows.append(row)
                n.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hit])
                names.append(sorted({a.names[k] for k in who} - {None}))
                longest.append(most)
            new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int32())]
            old = [b.column(c).take(pa.array(rows, pa.int64())) if hits_only else b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*old, *new], [*rest, *_FOUND])

    return run


def _in_turns(docs: DataFrame, packed: bytes, more: Iterator[tuple[bytes, bool]], text: str) -> DataFrame:
    """find_hits() for several automata: documents are written once, with a number each; a pass over them per automaton
    reads their texts alone and writes the rows with hits alone, which are merged by number and joined back. Longest
    matches of documents without hits are not told apart from none: 0."""
    spark = docs.sparkSession
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    kept = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = kept.select(F.col(row).alias("row"), F.col(text).alias("text"))
    kind = f"row bigint, n_words bigint, hit_spans {_SPANS}, hit_items array<string>, longest_match int"
    parts, turns = None, [(packed, False)]
    for one, _ in itertools.chain(turns, more):
        found = saved(texts.mapInArrow(_scanner(spark, one, "text", ["row"], hits_only=True), kind), free=False)
        parts = found if parts is None else parts.unionByName(found)

    def together(batches):
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in merged([[x["start"], x["end"]] for x in row])] for row in b.column("hit_spans").to_pylist()]
            yield b.set_column(1, "hit_spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))

    found = parts.groupBy(F.col("row").alias("_of")).agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"), F.max("longest_match").alias("longest_match"))
    found = found.mapInArrow(together, f"_of bigint, hit_spans {_SPANS}, hit_items array<string>, longest_match int")
    count = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))).cast("bigint")
    out = kept.join(found, F.col(row) == F.col("_of"), "left").withColumns({"n_words": count, "hit_spans": F.coalesce("hit_spans", F.array().cast(_SPANS)), "hit_items": F.coalesce("hit_items", F.array().cast("array<string>")), "longest_match": F.coalesce("longest_match", F.lit(0))})
    return out.select(*docs.columns, *_FOUND)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))


def remove_hits(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The decontaminated documents: hit words go (the rest keeps its words as they were, joined by one blank), and a
    document of which more than max_coverage is hit goes altogether. Documents without hits keep their very text."""
    found = find_hits(docs, items, text, window)
    schema = docs.schema
    keep = docs.columns

    def run(batches):
        for b in batches:
            texts, rows = [], []
            for row, (t, n, spans) in enumerate(zip(b.column(text).to_pylist(), b.column("n_words").to_pylist(), b.column("hit_spans").to_pylist(), strict=True)):
                hit = sum(s["end"] - s["start"] for s in spans)
                if hit > max_coverage * max(n, 1):
                    continue
                rows.append(row)
                texts.append(_without(t, spans) if hit else t)
            b2 = b.take(pa.array(rows, pa.int64()))
            cols = [pa.array(texts, b.schema.field(text).type) if c == text else b2.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(cols, keep)

    return found.mapInArrow(run, schema)


def _without(text: str, spans: list[dict]) -> str:
    """text without the hit words; what stands between two removed words goes too."""
    raw = text.encode()
    flat = raw.translate(_TO)
    bounds, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : bounds[s["start"]][0]])
        at = bounds[s["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _sha(ids: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", ids), 256)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), _sha(F.col("hit_items")).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))
