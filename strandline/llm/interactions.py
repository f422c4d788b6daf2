"""Operator 12: how filters of a corpus interact, audited through the Walsh-Hadamard transform.

Each document has a mask of the filters that it fails. For every part and label one aggregate takes the signed parity sums
W[S] = sum of (-1)^|mask & S| over all sets S of filters: 32 of them for five filters. The transform is its own inverse up
to the factor 32, so the number of documents with each exact mask follows in whole numbers, and from those 32 cells every
order of the filters can be told without another look at the documents. A document that fails c filters is removed by each
of them in n!/c of the n! orders, which gives the Shapley count in closed form.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import saved, table

#: The filters of the query: few words, few distinct words, many capitals, symbols, repeated text.
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS, WORD = 200, 50, 3, "[#$%&*|]", "[^\\x20\\x09-\\x0D]+"


def own_failures(text: Column) -> list[Column]:
    """What filters A to D of the query say of a text (null: empty): one condition each, true where it fails."""
    text = F.coalesce(text, F.lit(""))
    # the words are split once: what is bound in the lambda is not worked out again
    counts = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        counts["words"] < MIN_WORDS,
        100 * counts["distinct"] < DISTINCT_PERCENT * counts["words"],
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        F.regexp_like(text, F.lit(SYMBOLS)),
    ]


def repeated(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """rows with `repeats`: does a row of a smaller key have the same digest? Rows without key, and all rows of the least
    key, do not. Digests with one key are not joined at all; the least keys come from a written table, so that adaptive
    execution may split the rows of a digest with very many of them."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(F.col(digest).alias("_of")).agg(F.min(key).alias("_least"), F.max(key).alias("_most"))
    least = saved(least.filter("_least < _most").drop("_most"), free=False)
    out = rows.join(least, F.col(digest) == F.col("_of"), "left")
    return out.withColumn("repeats", F.coalesce(F.col(key) > F.col("_least"), F.lit(False))).drop("_of", "_least")


def spectrum(rows: DataFrame, part: str, mask: str, n: int, marks: list[str]) -> DataFrame:
    """(part, w_all, w_<mark>...): for each part the 2^n signed parity sums of its masks, over all rows and over the rows
    where a mark is true. Sums are added up in each task before they are shuffled, so a hot part costs a row a task."""

    def sums(weight: Column) -> Column:
        signed = [F.when(F.bit_count(F.col(mask).bitwiseAND(s)) % 2 == 0, weight).otherwise(-weight) for s in range(1 << n)]
        return F.array(*[F.sum(x) for x in signed])

    return rows.groupBy(part).agg(sums(F.lit(1).cast("bigint")).alias("w_all"), *[sums(F.when(F.col(m), 1).otherwise(0).cast("bigint")).alias(f"w_{m}") for m in marks])


def cells(w: Column, n: int) -> Column:
    """The number of rows with each mask from their signed parity sums. Division by 2^n leaves no rest."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda m, s: F.lit(1) - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    total = lambda m: F.aggregate(sets, F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(w, s) * sign(m, s))
    return F.transform(sets, lambda m: F.shiftright(total(m), n))


def orders(parts: DataFrame, names: str, marks: list[str]) -> DataFrame:
    """All orders of the filters, step by step, for each part with its cells (c_all, c_<mark>)."""
    n = len(names)
    design = [(order, k + 1, 1 << names.index(f), sum(1 << names.index(x) for x in order[:k])) for order in map("".join, permutations(names)) for k, f in enumerate(order)]
    fields = ["filter_order", "step", "_bit", "_before"]
    # one constant, which the optimizer folds
    steps = F.from_json(F.lit(json.dumps([dict(zip(fields, d)) for d in design])), "array<struct<filter_order:string,step:int,_bit:int,_before:int>>")
    rows = parts.select("*", F.inline(steps))
    bit, before = F.col("_bit"), F.col("_before")
    masks = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def count(of: str, which, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("bigint"), lambda acc, m: acc + F.when(which(m), F.get(F.col(of), m) * weight(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # n!/c for a mask of c filters: n! is a multiple of each c up to n
    share = lambda m: F.element_at(F.array(*[F.lit(factorial(n) // c).cast("bigint") for c in range(1, n + 1)]), F.greatest(F.bit_count(m), F.lit(1)))
    return rows.select(
        *[c for c in parts.columns if not c.startswith("c_")],
        "filter_order",
        "step",
        count("c_all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        count("c_all", removed).alias("removed"),
        count("c_all", lambda m: fails(m) & gone(m)).alias("redundant"),
        count("c_all", lambda m: m == bit).alias("unique_fails"),
        *[count(f"c_{m}", removed).alias(f"{m}_lost") for m in marks],
        count("c_all", fails, share).alias("shapley"),
    )


def audit(rows: DataFrame, part: str, mask: str, names: str, marks: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, <mark>_lost, shapley.

    rows: a row a document with its part, the mask of the filters that it fails (bit k for the k-th of names) and boolean
    marks. A null part is a part like others, a null mark is false. A table without rows has no parts. Filters whose
    number is n make n! * n rows a part; they never grow with the documents."""
    n = len(names)
    sums = spectrum(rows, part, mask, n, marks)
    return orders(sums.select(part, *[cells(F.col(f"w_{m}"), n).alias(f"c_{m}") for m in ["all", *marks]]), names, marks)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of docs (doc_id, lang, text; other columns are passed over): five filters A to
    E, and whether any label of the doc_id says good or toxic. Null lang: part '' ; null text: empty; null doc_id: no
    labels and no repeat of anything. Rows that repeat doc_id and text are documents of their own, none repeats another."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own_failures(F.col("text")))]
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(raw.cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = saved(rows, free=False)  # texts are read once
    rows = repeated(rows, "doc_id", "digest")
    named = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(saved(named, free=False), F.col("doc_id") == F.col("_doc"), "left")
    return rows.select("part", (F.col("mask") + F.when(F.col("repeats"), 16).otherwise(0)).alias("mask"), *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("good", "toxic")])


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all 120 orders, for each language."""
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, "part", "mask", "ABCDE", ["good", "toxic"])


OP12_SQL = """
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t.t, '[A-Z]')) > 3 * length(t.t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > least THEN 16 ELSE 0 END AS m
  FROM t JOIN e ON e.t = t.t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT b1.f || b2.f || b3.f || b4.f || b5.f AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
  FROM b b1, b b2, b b3, b b4, b b5 WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31 AND len(list_distinct([b1.f, b2.f, b3.f, b4.f, b5.f])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
