"""Operator 11: a Merkle manifest of a dataset, and proofs by coordinates.

Rows of a group (a language) are the leaves of a tree in which every FAN consecutive nodes have one parent; the groups' roots
are the leaves of a second tree. All nodes are written as one table (tree, level, at). A leaf's proof needs the nodes at
coordinates that follow from its index and its group's size alone: each leaf explodes them, they are joined with the node
table, put in order, concatenated for the proof's digest and folded up to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.llm.common import saved, table

FAN = 8
#: A level of at most so many nodes (about 60 bytes each) is broadcast. Every node of a larger level is asked for by less
#: than 2 * FAN / BROADCAST_NODES of all leaves, so the shuffled joins have no hot key.
BROADCAST_NODES = 1 << 14


def leaf_of(*columns: Column) -> Column:
    """H of the columns: '-' for null, else UTF-8 byte count, ':' and value."""
    as_text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text]).cast("binary"), 256)


def _running(counts: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """(key, before): the sum of n over all smaller keys, by blocks of keys."""
    ahead = lambda w: w.rowsBetween(W.Window.unboundedPreceding, -1)
    each = counts.select(F.col(key), F.col(n), F.floor(F.col(key) / block).alias("_block"))
    lead = each.groupBy(F.col("_block").alias("_b")).agg(F.sum(n).alias("_n"))
    lead = lead.select("_b", F.coalesce(F.sum("_n").over(ahead(W.Window.orderBy("_b"))), F.lit(0)).alias("_lead"))
    own = each.withColumn("_own", F.coalesce(F.sum(n).over(ahead(W.Window.partitionBy("_block").orderBy(key))), F.lit(0)))
    return own.join(lead, F.col("_block") == F.col("_b")).select(key, (F.col("_own") + F.col("_lead")).alias("before"))


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, at and n; groups as (tree, group, n)): tree numbers the groups in order (null first, then bytewise),
    at numbers the rows of a group in the given order (nulls first), n is the group's size.

    Rows are dealt into ranges of the whole order, so that a group with most of the rows is spread over many tasks; a row's
    number is that inside its range plus the range's start. Rows that are equal in all of the order follow as they are read."""
    tie, at_range = "_tie", "_range"
    rows = saved(rows.withColumn(tie, F.monotonically_increasing_id()), free=False)
    dealt = saved(rows.repartitionByRange(group, *order, tie).withColumn(at_range, F.spark_partition_id()), rows, free=False)
    counts = saved(dealt.groupBy(group, at_range).agg(F.count("*").alias("_n")), free=False)
    groups = counts.groupBy(group).agg(F.min(at_range).alias("_first"), F.sum("_n").alias("n"))
    fresh = groups.groupBy("_first").agg(F.count("*").alias("_groups"))
    start = _running(fresh, "_first", "_groups").withColumnRenamed("_first", "_f")
    groups = groups.withColumn("_own", F.row_number().over(W.Window.partitionBy("_first").orderBy(group))).join(start, F.col("_first") == F.col("_f"))
    groups = saved(groups.select((F.col("before") + F.col("_own") - 1).cast("bigint").alias("tree"), group, "n"), free=False)
    ahead = W.Window.partitionBy(group).orderBy(at_range).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col(at_range).alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_from"))
    starts = starts.join(groups, F.col("_g").eqNullSafe(F.col(group))).select("_g", "_r", "_from", "tree", "n")
    own = F.row_number().over(W.Window.partitionBy(at_range, group).orderBy(*order, tie))
    out = dealt.withColumn("_own", own).join(starts, (F.col(at_range) == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    out = out.select(*[c for c in rows.columns if c != tie], "tree", (F.col("_from") + F.col("_own") - 1).cast("bigint").alias("at"), "n")
    return saved(out, dealt, free=False), groups


def _size(n: Column, level: int) -> Column:
    """Nodes at a level of a tree with n leaves."""
    return F.floor((n + (FAN**level - 1)) / F.lit(FAN**level)).cast("bigint") if level else n


def _digest(hashes: Column) -> Column:
    """Hex digests in a row as one text."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "")


def levels_of(sizes: DataFrame) -> list[int]:
    """How many nodes of trees that go on each level has, from the trees' sizes (n); a tree ends at its single node."""
    most = sizes.agg(F.max("n")).first()[0] or 0
    depth = 0
    while FAN**depth < most:
        depth += 1
    if not depth:
        return []
    got = sizes.agg(*[F.sum(F.when(_size(F.col("n"), k) > 1, _size(F.col("n"), k)).otherwise(0)) for k in range(depth)]).first()
    return [int(x) for x in got]


def nodes_of(leaves: DataFrame, depth: int) -> DataFrame:
    """The node table (tree, level, at, n, hash) of leaves (tree, at, n, leaf as hex): n is the number of nodes that the tree
    has on the level; the one node of a level with n = 1 is the tree's root. Each level is written before the next is built
    from it, and a parent has FAN children at most."""
    level = leaves.select("tree", F.lit(0).alias("level"), "at", "n", F.unhex("leaf").alias("hash"))
    out = level
    for k in range(1, depth + 1):
        up = level.filter("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("up")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("kids"))
        joined = F.sha2(_digest(F.transform("kids", lambda x: x["hash"])).cast("binary"), 256)
        level = saved(up.select("tree", F.lit(k).alias("level"), F.col("up").alias("at"), _size(F.col("n"), 1).alias("n"), F.unhex(joined).alias("hash")), free=False)
        out = out.unionByName(level)
    return out


def _wanted(at: Column, n: Column, levels: list[int]) -> Column:
    """The coordinates (level, at, slot) of all nodes that a proof needs: those that share a parent with the leaf or one of
    its ancestors. slot = level * FAN + place under the parent puts them in order."""

    def at_level(k: int) -> Column:
        mine, size = F.floor(at / F.lit(FAN**k)).cast("bigint"), _size(n, k)
        first = mine - mine % FAN
        others = F.filter(F.sequence(first, F.least(first + FAN - 1, size - 1)), lambda x: x != mine)
        coordinates = F.transform(others, lambda x: F.struct(F.lit(k).alias("level"), x.alias("want"), (k * FAN + x % FAN).cast("int").alias("slot")))
        return F.when(size > 1, coordinates).otherwise(F.array().cast("array<struct<level:int,want:bigint,slot:int>>"))

    return F.flatten(F.array(*[at_level(k) for k in levels]))


def path_of(at: Column, n: Column, depth: int) -> Column:
    """The leaf's and its ancestors' own slots, one for each level below the root."""
    return F.array_compact(F.array(*[F.when(_size(n, k) > 1, (k * FAN + F.floor(at / F.lit(FAN**k)) % FAN).cast("int")) for k in range(depth)], F.lit(None).cast("int")))


def proofs(leaves: DataFrame, nodes: DataFrame, per_level: list[int]) -> DataFrame:
    """(tree, at, siblings): what the node table has at the coordinates that each leaf wants, in order, as (slot, hash).
    Leaves that want nothing (alone in their tree) have no row. A leaf gets FAN - 1 rows a level at most."""
    kind, parts = "tree bigint, at bigint, found array<struct<slot:int,hash:binary>>", []
    small = [k for k, n in enumerate(per_level) if n <= BROADCAST_NODES]
    for levels, hint in ((small, F.broadcast), ([k for k in range(len(per_level)) if k not in small], lambda x: x)):
        if levels:
            asked = leaves.select("tree", "at", F.inline(_wanted(F.col("at"), F.col("n"), levels)))
            held = nodes.filter(F.col("level").isin(levels)).select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("at").alias("_a"), "hash")
            got = asked.join(hint(held), (F.col("tree") == F.col("_t")) & (F.col("level") == F.col("_l")) & (F.col("want") == F.col("_a")))
            parts.append(got.groupBy("tree", "at").agg(F.collect_list(F.struct("slot", "hash")).alias("found")))
    if not parts:
        return leaves.sparkSession.createDataFrame([], kind.replace("found", "siblings"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("tree", "at").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("siblings"))


def folded(leaf: Column, path: Column, siblings: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""

    def up(acc: Column, slot: Column) -> Column:
        first = slot - slot % FAN
        left = F.filter(siblings, lambda s: (s["slot"] >= first) & (s["slot"] < slot))
        right = F.filter(siblings, lambda s: (s["slot"] > slot) & (s["slot"] < first + FAN))
        run = F.concat(_digest(F.transform(left, lambda s: s["hash"])), acc, _digest(F.transform(right, lambda s: s["hash"])))
        return F.sha2(run.cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", shown: str = "shown") -> DataFrame:
    """rows with tree, at, n, subroot, root, siblings (own tree), above (siblings in the tree of groups), proof_sha256,
    folded_root and verified. leaf is a row's digest as the manifest has it, shown the digest as a holder of the row would
    recompute it now; folded_root starts from shown. Rows of a null group are a group; equal rows are leaves of their own,
    and as the order ends with the leaf, ties of the order change no digest. A single row's leaf is its group's root, and a
    single group's root is the root. An empty table has no rows and no root."""
    leaves, groups = placed(rows, group, [*order, leaf])
    per_level = levels_of(groups)
    nodes = saved(nodes_of(leaves.withColumnRenamed(leaf, "leaf"), len(per_level)), free=False)
    tops = nodes.filter("n = 1").select("tree", F.lower(F.hex("hash")).alias("subroot"))

    count = groups.count()
    upper = saved(tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(count).cast("bigint").alias("n"), F.col("subroot").alias("leaf")), free=False)
    upper_levels = levels_of(upper.limit(1))
    upper_levels = [-(-count // FAN**k) for k in range(len(upper_levels))]
    upper_nodes = saved(nodes_of(upper, len(upper_levels)), free=False)
    top = upper_nodes.filter("n = 1").select(F.lower(F.hex("hash"))).first()
    above = proofs(upper, upper_nodes, upper_levels).select(F.col("at").alias("_u"), F.col("siblings").alias("above"))
    # by size: few groups are broadcast by Spark itself; of many, a hot one is split, as both sides are shuffled as read
    about = saved(upper.join(above, F.col("at") == F.col("_u"), "left").select(F.col("at").alias("_tree"), F.col("leaf").alias("subroot"), "above"), free=False)

    found = proofs(leaves, nodes, per_level).select(F.col("tree").alias("_t"), F.col("at").alias("_a"), "siblings")
    out = leaves.join(found, (F.col("tree") == F.col("_t")) & (F.col("at") == F.col("_a")), "left").join(about, F.col("tree") == F.col("_tree")).drop("_t", "_a", "_tree")
    empty = F.array().cast("array<struct<slot:int,hash:binary>>")
    out = out.withColumns({"siblings": F.coalesce("siblings", empty), "above": F.coalesce("above", empty), "root": F.lit(top[0] if top else None).cast("string")})
    proof = F.sha2(F.concat(_digest(F.transform("siblings", lambda s: s["hash"])), _digest(F.transform("above", lambda s: s["hash"]))).cast("binary"), 256)
    subroot = folded(F.col(shown), path_of(F.col("at"), F.col("n"), len(per_level)), F.col("siblings"))
    root = folded(subroot, path_of(F.col("tree"), F.lit(count), len(upper_levels)), F.col("above"))
    return out.withColumns({"proof_sha256": proof, "folded_root": root}).withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, shown) of documents; other columns are passed over. shown has the text's A-Z lower-cased where 3
    divides the CRC-32 of the decimal doc_id; a null doc_id or text is left alone."""
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = docs.select("doc_id", "lang", leaf_of(*known, F.col("text")).alias("leaf"), F.when(hit, leaf_of(*known, lowered)).alias("_low"))
    return out.select("doc_id", "lang", "leaf", F.coalesce("_low", "leaf").alias("shown"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language; a third of the texts is tampered with, which the folded root shows."""
    out = manifest(leaves_of(table(spark, sf_dir, "documents")), "lang", ["doc_id"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels that the SQL builds: trees of up to FAN ** SQL_LEVELS leaves.
SQL_LEVELS = 6
_FIELD = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_BITS = "list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {start})"
#: CRC-32 of a text of ASCII characters, byte by byte and bit by bit.
_CRC = f"xor(list_reduce(list_transform(range(1, len({{s}}) + 1), lambda k: CAST(ascii({{s}}[k]) AS BIGINT)), lambda c, b: {_BITS.format(start='xor(c, b)')}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_tree(p: str, levels: int) -> str:
    """CTEs over {p}0 (g, i, h, n): {p}k are the nodes of level k, {p}r<k> the runs under one parent; a tree that has come to
    one node stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"{p}r{k} AS (SELECT g, i // {FAN} AS i, list(h ORDER BY i) AS run, max(n) AS n FROM {p}{k} GROUP BY ALL)")
        out.append(f"{p}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, (n + {FAN - 1}) // {FAN} AS n FROM {p}r{k})")
    return ", ".join(out)


def _sql_climb(p: str, start: str, levels: int) -> str:
    """CTEs {p}f<k> that follow each row of {start} (row, g, i, f, proof) up its tree."""
    out, before = [], start
    for k in range(levels):
        left, right = f"array_to_string(run[:b.i % {FAN}], '')", f"array_to_string(run[b.i % {FAN} + 2:], '')"
        out.append(f"{p}f{k} AS (SELECT b.row, b.g, b.i // {FAN} AS i, CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {before} b JOIN {p}r{k} r ON r.g = b.g AND r.i = b.i // {FAN})")
        before = f"{p}f{k}"
    return ", ".join(out)


OP11_SQL = f"""
WITH s AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
d AS (SELECT doc_id, lang, {_sql_leaf("text")} AS leaf, CASE WHEN {_CRC.format(s="id")} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS low FROM s),
e AS (SELECT row_number() OVER () AS row, doc_id, leaf, coalesce(low, leaf) AS shown, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t0 AS (SELECT g, i, leaf AS h, n FROM e),
{_sql_tree("t", SQL_LEVELS)},
u0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t{SQL_LEVELS}),
{_sql_tree("u", SQL_LEVELS)},
tb AS (SELECT row, g, i, shown AS f, '' AS proof FROM e),
{_sql_climb("t", "tb", SQL_LEVELS)},
ub AS (SELECT row, 0 AS g, g AS i, f, proof FROM tf{SQL_LEVELS - 1}),
{_sql_climb("u", "ub", SQL_LEVELS)}
SELECT doc_id, leaf, t{SQL_LEVELS}.h AS subroot, u{SQL_LEVELS}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u{SQL_LEVELS}.h AS verified
FROM e JOIN uf{SQL_LEVELS - 1} v ON v.row = e.row JOIN t{SQL_LEVELS} ON t{SQL_LEVELS}.g = e.g, u{SQL_LEVELS}
"""
