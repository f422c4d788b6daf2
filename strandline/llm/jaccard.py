"""Operator 4: n-gram Jaccard join by prefix filters under several global token orders.

A text's tokens are the hashes of its distinct word n-grams. Under any one order of all tokens, two sets of similarity
t share one of their first n - ceil(t n) + 1 tokens; this holds for every order, so a candidate pair must pass all of
them before it is verified on the whole sets.

* Texts with equal sets are one node; copies are counted, never paired.
* Order 1 puts rare tokens first. How rare comes from a fixed number of counting bins over all tokens, a proven bound on
  what is broadcast; bins that are shared only make the order less sharp, as any total order is exact.
* Nodes that share a token of the first prefix (and are alike in size) are joined into candidate groups through the
  least node of each token: as many links as tokens, not pairs.
* Groups of several blocks are narrowed first: unlike texts that share a rare token each link up into ever larger groups as
  the corpus grows. Each token's list is looked through with the parities of its sets' tokens on a few hundred bits, which
  can't differ in more bits than the sets do in tokens; only what leaves room for a link stays in one group.
* Each group's texts are gathered once, packed, one for each node, in blocks of bounded size. In a block the sets are
  taken again from the texts, all three filters are intersected and what passes, unless it is connected already, is
  verified. A task emits a spanning forest of its links, never all pairs.
* A group of several blocks is linked in two passes. First each block is verified together with a few hub nodes that all
  blocks of the group get: near copies of one text become one component in linear work. Then, only in groups that are
  still more than one component, blocks meet two by two, except blocks of one and the same component, so that no pair
  that could join two components is left out.
* Components over these links give the answer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import components, dropped, plus, saved, sketch, table, tune
from strandline.llm.textkit import U64, mix, slices, window_hash, words_of

#: Counting bins of the first order, a byte each when broadcast.
BINS = 1 << 25
#: Bits of the filter that tells which nodes are in groups.
FILTER_BITS = 1 << 24
#: Nodes and tokens in a block; a larger set is a block of its own.
BLOCK_NODES, BLOCK_TOKENS = 128, 400_000
#: Hubs of a group, about so many (and no more than a block's share of its nodes).
HUBS = 16
#: Nodes whose prefixes a task remembers having sent.
REMEMBERED = 1 << 17
#: Bits that stand for a set when lists are looked through, at most, and rows of a list in one task.
MOST_BITS, LIST_ROWS = 2048, 1 << 13


def token_sets(column: pa.Array, n: int):
    """For each row of a column its sorted distinct n-gram hashes; one hash of the whole for fewer words, none for no words."""
    for _, _, data, bounds in slices(column):
        w = words_of(data, bounds, lower=True)
        count = np.diff(w.first)
        g, same = w.grams(n)
        i = np.flatnonzero(same)
        doc, h = w.doc[i], g[i]
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            whole = np.array([window_hash(w.h[w.first[d] : w.first[d + 1]], int(count[d]))[0] for d in few], np.uint64)
            doc, h = np.concatenate([doc, few]), np.concatenate([h, whole])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        at = np.searchsorted(doc, np.arange(len(count) + 1))
        for d in range(len(count)):
            yield h[at[d] : at[d + 1]]


def node_of(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def prefix_len(n: int, percent: int) -> int:
    """Tokens of a set of n of which one is shared with any set that is percent similar."""
    return n - -(-percent * n // 100) + 1


def _ranked(tokens: np.ndarray, order: int, levels: np.ndarray | None = None) -> np.ndarray:
    """Tokens in a global order: 0 by level, then hash; others by hashes with seeds of their own."""
    key = mix(tokens + U64(0x1234_5677 * (order + 1)))
    if levels is not None:
        return tokens[np.lexsort((key, levels[(tokens % U64(len(levels))).astype(np.int64)]))]
    return tokens[np.argsort(key, kind="stable")]


def index_len(n: int, percent: int) -> int:
    """Tokens of a set of n of which one is among the prefix_len() first of any percent similar set that is not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def short(name: bytes) -> int:
    """64 bits of a node, enough for forming groups: a collision only makes a group larger."""
    return int.from_bytes(name[:8], "little", signed=True)


def _band(n: int, percent: int) -> int:
    """Number of a size class; sets that are percent similar are in the same or neighbouring classes."""
    return int(np.floor(np.log(n) / -np.log(percent / 100) + 1e-9))


def _prefix_keys(tokens: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """Keys of a set's first prefix: a node meets its own size class, and as the smaller one the next larger class."""
    band = _band(len(tokens), percent)
    head = _ranked(tokens, 0, levels)[: prefix_len(len(tokens), percent)]
    own = ((0, head), (1, head[: index_len(len(tokens), percent)]))
    return np.concatenate([mix(some + U64((band + step) * 0x9E3779B97F4A7C15 % (1 << 64))) for step, some in own]).view(np.int64)


def parities(tokens: np.ndarray, percent: int) -> bytes:
    """A set as some bits, each the parity of the number of its tokens that fall on it: two sets differ in at least as many
    tokens as in bits. There are about four times as many bits as tokens in which similar sets of this size may differ, so
    that unlike sets, of which half of the bits differ, are told apart."""
    most = 2 * len(tokens) * (100 - percent) // (100 + percent)
    bits = min(MOST_BITS, 1 << max(6, (4 * most).bit_length()))
    odd = np.bincount((mix(tokens + U64(0x5EED)) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: bytes, width: int) -> bytes:
    """Parities on fewer bits: those of the halves put on each other."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _near(t: pa.Table, percent: int) -> pa.Table:
    """Of (key, i, j, block, node, n, bits) rows, whole lists or pairs of blocks of long ones, pairs (a, b) that connect all
    nodes of a list between which parities leave room for a link: fewer than the list has nodes."""
    t = t.sort_by([(c, "ascending") for c in ("key", "i", "j", "node")])
    key, i, j, block, node, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "block", "node", "n"))
    bits = t.column("bits").to_pylist()
    fresh = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    bounds = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(key)]])
    a, b = [], []
    for at, to in zip(bounds[:-1], bounds[1:]):
        width = min(map(len, bits[at:to]))
        x = np.frombuffer(b"".join(_folded(v, width) for v in bits[at:to]), np.uint64).reshape(to - at, -1)
        size, side, across, names = n[at:to], block[at:to], i[at] != j[at], node[at:to]
        label = np.arange(to - at)
        for q in range(to - at - 1):
            # what hangs together already needs no comparison
            open_ = label[q + 1 :] != label[q]
            if across:
                open_ &= side[q + 1 :] != side[q]
            others = np.flatnonzero(open_) + q + 1
            if not len(others):
                continue
            far = np.bitwise_count(x[others] ^ x[q]).sum(1, dtype=np.int64)
            hit = others[far * (100 + percent) <= (size[others] + size[q]) * (100 - percent)]
            labels, first = np.unique(label[hit], return_index=True)
            if len(labels):
                a.append(np.full(len(labels), names[q]))
                b.append(names[hit[first]])
                label[np.isin(label, labels)] = label[q]
    none = np.empty(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))}).filter(pc.field("a") != pc.field("b"))


def _bin_numbers(text: str, n: int, bins: int):
    def of(batch: pa.RecordBatch) -> np.ndarray:
        sets = list(token_sets(batch.column(text), n))
        return (np.concatenate(sets) % U64(bins)).astype(np.int64) if sets else np.empty(0, np.int64)

    return of


def _verify(sets: list[np.ndarray], split: int, percent: int, joined: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with a split, only links across it are looked for. joined: labels of
    the sets; those of one label are connected from the start.

    sets up to split are one block and the rest another. Filters under three orders, their candidates intersected,
    then exact intersections, both as products of incidence matrices."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    keys = np.concatenate(sets)
    first = range(split) if split else range(m)
    second = np.arange(split, m)
    prefix = np.array([prefix_len(int(n), percent) for n in size])
    ok = np.minimum(size[:, None], size[None, :]) * 100 >= percent * np.maximum(size[:, None], size[None, :])
    # local rarity is a total order of the group's tokens, and two seeded hashes are orders of all tokens
    for k in range(3):
        rank = np.lexsort((mix(keys + U64(0x1234_5677 * (k + 1))), count[token] if k == 0 else np.zeros(len(keys)), owner))
        place = np.arange(len(keys)) - bounds[owner]
        head = rank[place < prefix[owner]]
        own, tok = owner[head], token[head]
        _, tok = np.unique(tok, return_inverse=True)
        hit = _shared(own, tok, m) > 0
        ok &= hit
        if not ok.any():
            return []
    np.fill_diagonal(ok, False)
    root = np.arange(m)
    if joined is not None:
        _, head, label = np.unique(np.array(joined, object), return_index=True, return_inverse=True)
        root = head[label]
        ok &= label[:, None] != label[None, :]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    common = None
    for i in first:
        among = np.flatnonzero(ok[i, i + 1 :]) + i + 1 if not split else second[ok[i, second]]
        for j in among:
            a, b = find(i), find(int(j))
            if a == b:
                continue
            if common is None:
                common = _shared(owner, token, m)
            c = int(round(common[i, j]))
            if 100 * c >= percent * (size[i] + size[j] - c):
                root[b] = a
                links.append((int(i), int(j)))
    return links


def _shared(owner: np.ndarray, token: np.ndarray, m: int, width: int = 4096) -> np.ndarray:
    """Numbers of common tokens of every two owners: products of incidence matrices, some token columns at a time."""
    n = np.bincount(token)
    keep = n[token] >= 2
    owner, token = owner[keep], token[keep]
    out = np.zeros((m, m), np.float32)
    if not len(token):
        return out
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    top = int(token[-1]) + 1
    for at in range(0, top, width):
        a, b = np.searchsorted(token, [at, at + width])
        x = np.zeros((m, min(width, top - at)), np.float32)
        x[owner[a:b], token[a:b] - at] = 1
        out += x @ x.T
    return out


def nodes(df: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """df's other columns with node (128 bits that stand for the token set, empty without tokens) and n_shingles."""
    rest = [c for c in df.columns if c not in (text, "node", "n_shingles")]
    df = df.select(*rest, text)

    def run(batches):
        for b in batches:
            sets = [(node_of(s), len(s)) for s in token_sets(b.column(text), n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([s[0] for s in sets], pa.binary()), pa.array([s[1] for s in sets], pa.int64())], [*rest, "node", "n_shingles"])

    return df.mapInArrow(run, plus(df.select(*rest).schema, "node binary, n_shingles bigint"))


def _short(node: F.Column) -> F.Column:
    """short() as a column: the bytes turned round, as hex, two 32-bit halves."""
    turned = F.reverse(F.substring(F.hex(node), 1, 16))
    # reverse() also turns the two digits of each byte
    digits = F.regexp_replace(turned, "(.)(.)", "$2$1")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def connected(df: DataFrame, base: DataFrame, text: str = "text", n: int = 3, percent: int = 90, bins: int = BINS) -> DataFrame:
    """(node, root): the component of every node (base: the texts' rows from nodes()) that is linked with another by at
    least percent similarity."""
    spark = df.sparkSession
    df, base = df.select(text), base.withColumn("short", _short(F.col("node")))
    levels = spark.sparkContext.broadcast(sketch(df, _bin_numbers(text, n, bins), bins))

    def heads(batches):
        # copies are one node: a task says its prefix once, as long as it remembers it
        said: set[bytes] = set()
        for b in batches:
            keys, names = [], []
            for s in token_sets(b.column(text), n):
                if not len(s) or (name := node_of(s)) in said:
                    continue
                if len(said) < REMEMBERED:
                    said.add(name)
                keys.append(_prefix_keys(s, percent, levels.value))
                names.append(np.full(len(keys[-1]), short(name), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], ["key", "node"])

    entries = df.mapInArrow(heads, "key bigint, node bigint")
    # prefixes are worked out and sent once: the least node of each token's list comes from a window over the list
    edges = entries.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("key")).alias("b")).filter("a <> b").distinct()
    groups = components(edges).withColumnRenamed("node", "member")
    # from here on the whole node is the key; nodes of one short are in one group
    # how many blocks a group needs; a node's block is a hash of it, so blocks are even
    sizes = base.filter("n_shingles > 0").groupBy("node").agg(F.first("short").alias("short"), F.max("n_shingles").alias("n"))
    groups = groups.join(sizes, F.col("member") == F.col("short")).select("node", "short", "root", "n")
    groups = saved(groups.select(F.col("node").alias("member"), "short", "root", "n"))

    # the texts of grouped nodes only; a bitmap of fixed size keeps most others from being sent
    def bits(batch: pa.RecordBatch) -> np.ndarray:
        return (batch.column(0).to_numpy().view(np.uint64) % U64(FILTER_BITS)).astype(np.int64)

    wanted = spark.sparkContext.broadcast(np.packbits(sketch(groups.select("short"), bits, FILTER_BITS) > 0))

    def gathered(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=6)
        for b in batches:
            names, packed, bits = [], [], []
            for row, s in enumerate(token_sets(b.column(text), n)):
                if len(s):
                    name = node_of(s)
                    at = short(name) % (1 << 64) % FILTER_BITS
                    if wanted.value[at >> 3] >> (7 - (at & 7)) & 1:
                        names.append(name)
                        packed.append(c.compress(b.column(text)[row].as_py().encode()))
                        bits.append(parities(s, percent))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary()), pa.array(bits, pa.binary())], ["node", "z", "bits"])

    # copies have equal sets: one text of each node stays, before the shuffle where copies meet; packed text takes a
    # fraction of its set's bytes
    texts = df.mapInArrow(gathered, "node binary, z binary, bits binary").groupBy("node").agg(F.min("z").alias("z"), F.min("bits").alias("bits"))
    texts = saved(texts)
    groups = _dealt(_narrowed(texts, groups, levels, n, percent))
    own = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = texts.join(groups, F.col("node") == F.col("member")).select("node", "z", "root", F.explode(own).alias("i"))
    first = first.select("root", "i", F.col("i").alias("j"), F.col("i").alias("block"), F.lit(None).cast("binary").alias("comp"), "node", "z")
    found = components(_block_links(first, n, percent))
    rest = _unjoined(groups, found)
    if not rest.head(1):
        dropped(texts)
        return found
    # a block goes to every pair of blocks (i <= j) that it is part of
    second = texts.join(rest, F.col("node") == F.col("member")).select("node", "z", "root", "block", "comp", F.explode("others").alias("other"))
    second = second.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "node", "z")
    both = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_block_links(second, n, percent)))
    dropped(texts)
    return both


def _need(groups: DataFrame) -> DataFrame:
    """(r, members, tokens, blocks): how many blocks each group needs."""
    need = groups.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    return need.select(F.col("root").alias("r"), "members", "tokens", _blocks("members", "tokens").alias("blocks"))


def _dealt(groups: DataFrame) -> DataFrame:
    """groups with the number of their blocks, each node's block (a hash of it, so blocks are even) and whether it is a hub."""
    groups = groups.join(_need(groups), F.col("root") == F.col("r"))
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(9), "member"), F.greatest(F.ceil(F.col("members") / HUBS), "blocks")) == 0)
    return saved(groups.select("member", "short", "root", "n", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), hub.alias("hub")))


def _narrowed(texts: DataFrame, groups: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """groups, those of several blocks split into what hangs together by pairs that share a token of the first prefix and
    whose parities leave room for a link. Nodes that are left alone go."""
    large = _need(groups).filter("blocks > 1")
    tokens = large.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return groups
    large = saved(groups.join(large.select("r"), F.col("root") == F.col("r"), "left_semi"))

    def listed(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            keys, names = [], []
            for name, s in zip(b.column("short").to_pylist(), token_sets(pa.array([d.decompress(x).decode() for x in b.column("z").to_pylist()], pa.string()), n)):
                keys.append(_prefix_keys(s, percent, levels.value))
                names.append(np.full(len(keys[-1]), name, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], ["key", "node"])

    lists = texts.join(large, F.col("node") == F.col("member")).select("short", "z").mapInArrow(listed, "key bigint, node bigint")
    lists = lists.select("key", "node", F.count("*").over(Window.partitionBy("key")).alias("c")).filter("c > 1")
    # nodes of one short all stand in the lists of each
    known = texts.join(large, F.col("node") == F.col("member")).select("short", "n", "bits")
    parts = F.ceil(F.col("c") / LIST_ROWS).cast("int")
    rows = lists.join(known, F.col("node") == F.col("short")).drop("short").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a list of several blocks goes in pairs of them
    rows = rows.select("key", "block", "node", "n", "bits", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "bits")
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(32 + tokens // (1 << 20))))
    near = components(rows.groupBy("task").applyInArrow(lambda t: _near(t, percent), "a bigint, b bigint").distinct())
    near = near.select(F.col("node").alias("s"), F.col("root").alias("narrow"))
    # the root of a narrowed group is the short of one of its nodes, as that of any group
    split = large.join(near, F.col("short") == F.col("s")).select("member", "short", F.col("narrow").alias("root"), "n")
    small = groups.join(large.select(F.col("member").alias("m")), F.col("member") == F.col("m"), "left_anti")
    return small.unionByName(split)


def _blocks(members: str, tokens: str) -> F.Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK_NODES), F.ceil(F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _unjoined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(member, comp, root, block, others): the nodes of groups of several blocks that found leaves in more than one
    component, each in a block, and the numbers of the blocks that this one must meet.

    A component of half a block or more has blocks of its own, which needn't meet each other; the others share blocks,
    a component in one. Numbers: shared blocks first, then those of each large component in a row."""
    of = found.select(F.col("node").alias("c_node"), F.col("root").alias("c_root"))
    parts = groups.filter("blocks > 1").join(of, F.col("member") == F.col("c_node"), "left").select("member", "n", F.col("root").alias("g"), F.coalesce("c_root", "member").alias("comp"))
    parts = saved(parts)
    sizes = parts.groupBy("g", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    large = (F.col("m") * 2 >= BLOCK_NODES) | (F.col("t") * 2 >= BLOCK_TOKENS)
    sizes = sizes.withColumn("of_own", F.when(large, _blocks("m", "t")).otherwise(0))
    small = F.col("of_own") == 0
    whole = sizes.groupBy("g").agg(F.count("*").alias("comps"), F.sum("of_own").cast("int").alias("own"), F.coalesce(F.sum(F.when(small, F.col("m"))), F.lit(0)).alias("sm"), F.coalesce(F.sum(F.when(small, F.col("t"))), F.lit(0)).alias("st"))
    whole = whole.filter("comps > 1").select(F.col("g").alias("g2"), _blocks("sm", "st").alias("shared"), "own")
    # one row a large component, not a node
    order = Window.partitionBy("g").orderBy("comp")
    placed = sizes.filter(~small).withColumn("to", F.sum("of_own").over(order).cast("int")).select(F.col("g").alias("g3"), F.col("comp").alias("comp3"), "of_own", "to")
    rows = parts.join(whole, F.col("g") == F.col("g2")).join(placed, (F.col("g") == F.col("g3")) & (F.col("comp") == F.col("comp3")), "left")
    low, high, top = F.col("shared") + F.col("to") - F.col("of_own"), F.col("shared") + F.col("to"), F.col("shared") + F.col("own")
    mine = F.when(F.col("to").isNull(), F.pmod(F.xxhash64("comp"), F.col("shared"))).otherwise(low + F.pmod(F.xxhash64("member"), F.col("of_own")))
    none = F.array().cast("array<int>")
    upto, behind = F.when(low > 0, F.sequence(F.lit(0), low - 1)).otherwise(none), F.when(high < top, F.sequence(high, top - 1)).otherwise(none)
    others = F.when(F.col("to").isNull(), F.sequence(F.lit(0), top - 1)).otherwise(F.concat(upto, behind))
    return rows.select("member", "comp", F.col("g").alias("root"), mine.cast("int").alias("block"), others.alias("others"))


def _block_links(sent: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of (root, i, j, block, comp, node, z) rows: inside block i of a group where i = j, else between blocks i and
    j. Nodes of one comp are taken as connected, if comp isn't null."""
    sent = sent.withColumn("task", F.xxhash64("root", "i", "j"))

    def work(t: pa.Table) -> pa.Table:
        import zstandard

        d = zstandard.ZstdDecompressor()
        t = t.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("block", "ascending"), ("node", "ascending")])
        cols = [t.column(c).to_pylist() for c in ("root", "i", "j")]
        names, block, comp = (t.column(c).to_pylist() for c in ("node", "block", "comp"))
        tokens = list(token_sets(pa.array([d.decompress(x).decode() for x in t.column("z").to_pylist()], pa.string()), n))
        a, b, at = [], [], 0
        while at < t.num_rows:
            to = at
            while to < t.num_rows and all(c[to] == c[at] for c in cols):
                to += 1
            i, j = cols[1][at], cols[2][at]
            split = 0 if i == j else sum(x == i for x in block[at:to])
            if to - at > 1 and (i == j or 0 < split < to - at):
                for x, y in _verify(tokens[at:to], split, percent, comp[at:to] if comp[at] is not None else None):
                    a.append(names[at + x])
                    b.append(names[at + y])
            at = to
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return sent.groupBy("task").applyInArrow(work, "a binary, b binary")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, bins: int = BINS) -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the least key among the texts reachable by links of
    at least percent Jaccard similarity, the row's own copies included.

    A row without words has no shingles, no links and its own key as component_id. Null keys are passed over in the
    minimum; repeated rows are one node and each come out. An empty table gives none."""
    name, key = key, "key"
    df = df.select(F.col(name).alias(key), F.col(text).alias("text"))
    base = saved(nodes(df, "text", n))
    roots = connected(df, base, "text", n, percent, bins).select(F.col("node").alias("member"), "root")
    least = base.filter("n_shingles > 0").groupBy("node").agg(F.min(key).alias("low"))
    joined = least.join(roots, F.col("node") == F.col("member"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    whole = joined.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = saved(joined.join(whole, F.col("root") == F.col("r")).select(F.col("node").alias("member"), "component_id"))
    out = base.join(named, F.col("node") == F.col("member"), "left")
    return out.select(F.col(key).alias(name), "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def identity(key: str, text: str) -> F.Column:
    """128 bits that stand for a row's key and text, nulls told from empty ones."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.isnull(key).cast("string"), F.isnull(text).cast("string"), F.coalesce(text, F.lit("")))))


def survivors(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, bins: int = BINS) -> DataFrame:
    """(kept): identity() of one row of each component, that of the least key, nulls last, then of the least identity. A text
    without words has no links: each of those rows is kept, repeats of both key and text once."""
    df = df.select(F.col(key).alias("key"), identity(key, text).alias("name"), F.col(text).alias("text"))
    key, text = "key", "text"
    base = saved(nodes(df, text, n))
    roots = connected(df, base, text, n, percent, bins).select(F.col("node").alias("member"), "root")
    least = base.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.isnull(key).alias("nameless"), key, "name")).alias("low"))
    joined = least.join(roots, F.col("node") == F.col("member"), "left").select("low", F.coalesce("root", "node").alias("root"))
    one = joined.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.name").alias("kept"))
    return one.union(base.filter("n_shingles = 0").select("name").distinct())


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return classes(table(spark, sf_dir, "documents"))
