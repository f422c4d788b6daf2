"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder, but never on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.gettempdir()


def written(df: DataFrame, kind: str = "parquet", **options: str) -> str:
    """The path of a new folder with df's rows in it."""
    path = f"{shared_folder(df.sparkSession)}/strandline-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
