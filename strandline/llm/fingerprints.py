"""Operator 13 [native]: document fingerprints by winnowing, as DataFrame expressions only.

A text is cut into pieces: its words, longer ones every PIECE characters from their start, so that texts without blanks have
pieces too. Every run of GRAM pieces has a rolling (Rabin-Karp) hash; of every WINDOW consecutive hashes the least one is
kept, of equal ones the rightmost, together with its position. So two texts that share GRAM + WINDOW - 1 consecutive pieces
share a fingerprint hash, and one that two texts share stands for GRAM pieces that both have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.llm.common import table

PIECE, GRAM, WINDOW = 8, 5, 4
#: Modulus and base of the rolling hash; a piece's own value has 28 bits of its MD5.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
_LOW = (1 << 32) - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{PIECE}}}"), F.lit(0))


def winnowed(values: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The selected grams of an array of piece values (below 2^31), each as hash * 2^32 + (2^32 - 1 - position): the least
    one of a window has the least hash and, of equal ones, the rightmost position. Fewer pieces than gram are one gram,
    padded with zeros; fewer grams than window are one window; no pieces, no grams."""
    weights = [pow(BASE, gram - 1 - j, PRIME) for j in range(gram)]

    def rolled(t: Column, i: Column) -> Column:
        total = sum((F.coalesce(F.get(t, i + j), F.lit(0)) * w for j, w in list(enumerate(weights))[1:]), F.get(t, i) * weights[0])
        return F.shiftleft(F.pmod(total, F.lit(PRIME)), 32) + (F.lit(_LOW) - i)

    def grams(t: Column) -> Column:
        n = F.greatest(F.size(t) - (gram - 1), F.least(F.size(t), F.lit(1)))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: rolled(t, i.cast("bigint")))).otherwise(F.array().cast("array<bigint>"))

    def step(k: int) -> Callable[[Column], Column]:
        return lambda p: F.transform(p, lambda x, i: F.least(x, F.get(p, i + k)))

    def minima(p: Column) -> Column:
        # the least of 2, 4, ... from each place on, then of exactly `window`, by two overlapping runs
        done, out = 1, p
        while 2 * done <= window:
            out, done = bound(out, step(done)), 2 * done
        if done < window:
            out = bound(out, step(window - done))
        return F.slice(out, F.lit(1), F.greatest(F.size(p) - (window - 1), F.least(F.size(p), F.lit(1))))

    fresh = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
    return bound(bound(bound(values, grams), minima), fresh)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """A text's selected grams, see winnowed(). Null counts as empty; texts of blanks only have none."""
    value = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("bigint")
    return winnowed(F.transform(pieces(F.coalesce(text, F.lit(""))), value), gram, window)


def shown(selected: Column) -> Column:
    """hash:position for each selected gram, comma-joined: eight hex digits, and the position in pieces from 0."""
    return F.array_join(F.transform(selected, lambda x: F.concat(F.lower(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0")), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))), ",")


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of both fingerprints that are in both; 1 if neither has any."""

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))

    return bound(hashes(a), lambda x: bound(hashes(b), lambda y: of(x, y)))


def with_next(df: DataFrame, key: str, text: str, carried: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(key, text, carried..., next_text, next_<carried>...) for each row of df: the text, and what is worked out from it, of
    the next row in order of key; after the last row comes the first. Nulls come first, rows of one key in order of a hash
    of their text, rows equal in both as they are read. A single row is its own next.

    Rows are dealt once, into ranges of that order: the ranges' first keys are gathered (a row a range), and a range gets a
    copy of the next one's first row behind its own rows. A key with very many rows, or a row that repeats, takes as many
    ranges as it fills."""
    carried = carried or {}
    spark = df.sparkSession
    ranges = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    place = lambda: F.struct("k", "hash", "tie")
    dealt = rows.select("k", "hash", "tie").repartitionByRange(ranges, "k", "hash", "tie").select(place().alias("at"), F.spark_partition_id().alias("part"))
    starts = sorted(dealt.groupBy("part").agg(F.min("at").alias("at")).collect(), key=lambda r: r["part"])
    starts = [r["at"] for r in starts]
    kind = rows.select(place().alias("x")).schema["x"].dataType
    first = F.lit(None).cast(f"array<{kind.simpleString()}>")
    if starts:
        first = F.array(*[F.struct(F.lit(s["k"]).cast(kind["k"].dataType).alias("k"), F.lit(s["hash"]).cast("bigint").alias("hash"), F.lit(s["tie"]).cast("bigint").alias("tie")) for s in starts])
    # the last range that starts at or before a row, by halving
    halves = [1 << b for b in range(max(0, len(starts) - 1).bit_length() - 1, -1, -1)]
    jumps = F.array(*[F.lit(h) for h in halves]) if halves else F.array().cast("array<int>")
    found = bound(place(), lambda x: F.aggregate(jumps, F.lit(0), lambda at, h: F.when((at + h < len(starts)) & (F.get(first, at + h) <= x), at + h).otherwise(at)))
    own = rows.select(F.lit(0).alias("copy"), "k", "hash", "tie", "text", found.alias("range"))
    heads = spark.createDataFrame([((i - 1) % len(starts), s["k"], s["hash"]) for i, s in enumerate(starts)], f"range int, hk {kind['k'].dataType.simpleString()}, hh bigint")
    # the first rows' texts: a row for each range
    copies = rows.join(F.broadcast(heads), F.col("k").eqNullSafe(F.col("hk")) & (F.col("hash") == F.col("hh"))).groupBy("range").agg(F.first("text").alias("text"))
    copies = copies.select(F.lit(1).alias("copy"), F.lit(None).cast(kind["k"].dataType).alias("k"), F.lit(0).cast("bigint").alias("hash"), F.lit(0).cast("bigint").alias("tie"), "text", "range")
    # dealt before the carried columns are made, so that only texts travel
    both = own.unionByName(copies).repartition("range").withColumns({name: make(F.col("text")) for name, make in carried.items()})
    order = W.Window.partitionBy("range").orderBy("copy", "k", "hash", "tie")
    out = both.withColumn("next", F.lead(F.struct("text", *carried)).over(order)).filter("copy = 0")
    return out.select(F.col("k").alias(key), "text", *carried, *[F.col(f"next.{c}").alias(f"next_{c}") for c in ["text", *carried]])


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) characters replaced by the first as many of the other text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs; other
    columns are passed over. Null texts are empty: no characters, an empty fingerprint, like an empty text's by 1.0 and any
    other by 0.0. Equal texts have equal fingerprints. For the next document see with_next(). An empty table stays empty."""
    out = with_next(docs, key, text, {"f": fingerprint})
    out = out.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("e", fingerprint(F.col("edited")))
    return out.select(
        key,
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("f")).alias("fingerprint"),
        shown(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return compared(table(spark, sf_dir, "documents"))


_POWERS = [pow(BASE, GRAM - 1 - j, PRIME) for j in range(GRAM)]
_LAGS = " + ".join(f"coalesce(lead(v, {j}) OVER w, 0) * {p}" for j, p in enumerate(_POWERS))


def _sql_prints(name: str, column: str) -> str:
    """CTEs: {name} has for each row its selected grams (packed) and its distinct hashes, as lists in order."""
    return f"""
{name}_p AS (SELECT row, unnest(p) AS p, unnest(range(0, len(p))) AS i, len(p) AS n FROM (SELECT row, regexp_extract_all({column}, '[^\\x20\\x09-\\x0D]{{1,{PIECE}}}') AS p FROM t)),
{name}_v AS (SELECT row, i, n, CAST('0x' || substr(md5(p), 1, 7) AS BIGINT) AS v FROM {name}_p),
{name}_g AS (SELECT row, i, n, ({_LAGS}) % {PRIME} * 4294967296 + ({_LOW} - i) AS g FROM {name}_v WINDOW w AS (PARTITION BY row ORDER BY i)),
{name}_h AS (SELECT * FROM {name}_g WHERE i < greatest(n - {GRAM - 1}, 1)),
{name}_m AS (SELECT row, i, greatest(n - {GRAM - 1}, 1) AS m, min(g) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g FROM {name}_h),
{name}_s AS (SELECT DISTINCT row, g FROM {name}_m WHERE i < greatest(m - {WINDOW - 1}, 1)),
{name} AS (SELECT row, string_agg(lower(lpad(to_hex(g >> 32), 8, '0')) || ':' || ({_LOW} - (g & {_LOW})), ',' ORDER BY {_LOW} - (g & {_LOW})) AS f, list(DISTINCT g >> 32) AS h FROM {name}_s GROUP BY row)"""


def _sql_near(a: str, b: str) -> str:
    both = f"len(list_intersect(coalesce({a}, []), coalesce({b}, [])))"
    total = f"(len(coalesce({a}, [])) + len(coalesce({b}, [])))"
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / ({total} - {both}) END"


#: For tables whose doc_ids differ: rows of one doc_id follow by a hash that SQL doesn't have.
OP13_SQL = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS row, count(*) OVER () AS rows FROM documents),
t AS (SELECT a.doc_id, a.row, b.row AS next, a.text, left(a.text, (length(a.text) - length(a.text) // 2)::BIGINT) || left(b.text, (length(a.text) // 2)::BIGINT) AS edited FROM o a JOIN o b ON b.row = a.row % a.rows + 1),
{_sql_prints("a", "text")},
{_sql_prints("e", "edited")}
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.f, '') AS fingerprint, coalesce(e.f, '') AS edited_fingerprint, {_sql_near("a.h", "e.h")} AS near_edited, {_sql_near("a.h", "x.h")} AS near_next
FROM t LEFT JOIN a ON a.row = t.row LEFT JOIN e ON e.row = t.row LEFT JOIN a x ON x.row = t.next
"""
