"""From raw documents to token ids: five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard, pieces, pii, quality
from strandline.llm.common import scratch, table, tune

#: Near duplicates share four fifths of their distinct five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject. Labels are looked up among the incoming documents."""
    rules = quality.fit(docs, table(tune(spark), sf_dir, "labels"))
    return quality.judge(docs, rules).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, rows without doc_id last; of several
    such rows the one of the least hash. A doc_id that is null or repeated drops nothing: unlike texts all stay."""
    stay = jaccard.survivors(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    # repeats of both doc_id and text go before the shuffle; a plain key lets its partitioning serve the join too
    once = docs.withColumn("_name", jaccard.identity("doc_id", "text")).dropDuplicates(["_name"])
    return once.join(stay, F.col("_name") == F.col("kept"), "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly such passages go."""
    return decontaminate.remove_hits(docs, table(tune(spark), sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds."""
    return pii.mask(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and digests of ids and decoded text."""
    tune(spark)
    return pieces.round_trip(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", encoded),
]
#: Learned rules and token ids are beyond SQL. tests/llm compare near_duplicates and tokens with plain versions; of quality,
#: decontamination and masking only columns and row counts are compared in the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
