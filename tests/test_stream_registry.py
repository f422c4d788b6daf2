"""Typed micro-batches equal the fold of all rows as one table, however the rows fall into batches."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import registry as R
from strandline.schema import RAW, IngestSettings
from strandline.streaming import registry as S

TEXTS = ["1", "0", "7", "2.5", "x", "yes", "500 mV", "1 V", "1e5 kPa", "3 kPa", "", "2026-01-02 03:04:05", "nan", "-3.7"]


def rows_of(seed, n=160):
    r = random.Random(seed)
    times = ["1", "12.5", "2026-01-02 03:04:05", "Jan 2 1970", "nonsense", None]
    return [(("s", 0, i, 0), r.choice(times), r.choice("abcdef"), r.choice(TEXTS), "s", r.choice([None, None, "V"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_table(spark, tmp_path, seed):
    settings = IngestSettings(type_overrides={"e": "STRING"}, unit_overrides={"f": "V"})
    rows, at = rows_of(seed), 0
    r = random.Random(seed + 10)
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    while at < len(rows):
        some = rows[at : at + r.choice([1, 9, 70])]
        at += len(some)
        # inside a batch rows lie in any order
        spark.createDataFrame(r.sample(some, len(some)), RAW).repartition(3).write.mode("append").parquet(source)
        S.into_table(spark.readStream.schema(spark.createDataFrame([], RAW).schema).parquet(source), out, cp, settings).awaitTermination(120)
    got = spark.read.parquet(out)
    raw = spark.createDataFrame(rows, RAW)
    obs, reg = R.observations(raw, settings)
    named = obs.join(reg.select(F.col("id").alias("variable_id"), F.col("name").alias("variable_name")), "variable_id")
    columns = ["seq", "timestamp", "variable_name", "value_float", "value_int", "value_str", "value_bool", "quality", "original_timestamp", "source"]
    key = lambda x: x.seq.line
    assert sorted(got.select(columns).collect(), key=key) == sorted(named.select(columns).collect(), key=key)
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert sorted(map(str, shown(S.variables(got)))) == sorted(map(str, shown(reg)))


def test_fold_of_nothing_and_of_single_rows():
    import numpy as np

    known = (None, False, False, None)
    assert S.fold_rows(known, np.array([], object), np.array([], object))[0] == known
    for kind, unit, dtype in (("INTEGER", None, "INTEGER"), ("STRING", "kilopascal", "FLOAT"), ("STRING", None, "STRING")):
        after, dtypes, units = S.fold_rows(known, np.array([kind], object), np.array([unit], object))
        assert dtypes.tolist() == [dtype] and units.tolist() == [unit] and after[0] == dtype and not after[2]
