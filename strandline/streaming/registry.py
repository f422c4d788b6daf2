"""A registry that lives in a stream: types and units of variables as state, typed rows as they come.

Every variable is a key of keyed state, which holds its first type, whether a FLOAT or STRING has been seen since, and its
first unit. A micro-batch's rows of a variable are folded in order of `seq` behind those of earlier batches, so what comes out
equals the fold of all rows as one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions import normalize as N
from strandline.operators import registry as R
from strandline.schema import QUALITY, IngestSettings

#: A variable's state: its first type, what has been seen since, its first unit.
STATE = "first string, saw_float boolean, saw_string boolean, unit string"
Known = tuple[str | None, bool, bool, str | None]


def fold_rows(known: Known, kinds: np.ndarray, units: np.ndarray) -> tuple[Known, np.ndarray, np.ndarray]:
    """(state after, dtype and unit as of each row) of a variable's next rows, given the types of their texts and units."""
    first, was_float, was_string, unit = known
    new = np.zeros(len(kinds), bool)
    if first is None and len(kinds):
        first = "FLOAT" if units[0] is not None else kinds[0]
        new[0] = True  # a first row never widens itself
    floats = was_float | np.logical_or.accumulate((kinds == "FLOAT") & ~new)
    texts = was_string | np.logical_or.accumulate((kinds == "STRING") & ~new)
    if first == "INTEGER":
        dtypes = np.where(texts, "STRING", np.where(floats, "FLOAT", "INTEGER"))
    else:
        dtypes = np.where(texts, "STRING", "FLOAT") if first == "FLOAT" else np.full(len(kinds), first)
    own = np.array([u is not None for u in units], bool)
    if unit is None and own.any():
        at = int(own.argmax())
        held, unit = np.where(np.arange(len(kinds)) >= at, units[at], None), units[at]
    else:
        held = np.full(len(kinds), unit, object)
    after = (first, bool(was_float or floats[-1:].any()), bool(was_string or texts[-1:].any()), unit)
    return after, dtypes, held


def folded(stream: DataFrame, settings: IngestSettings | None = None) -> DataFrame:
    """A stream of raw rows (schema.RAW) with timestamp, value, row_unit, dtype and var_unit as of each row; rows whose time
    can't be read are left out. Rows of one variable must come in order of seq over batches; inside a batch any order does.

    A null variable name is a variable like others. State grows with the variables, not with the rows; a batch's rows of
    one variable go through one task, so batches bound what it holds."""
    s = settings or IngestSettings()
    time = N.timestamp(F.col("timestamp_raw"), s.timestamp_format or s.parser.timestamp_format)
    timed = stream.withColumn("timestamp", time)
    late = N.lenient_timestamp(F.when(F.col("timestamp").isNull(), F.col("timestamp_raw")))
    rows = R.parsed(timed.withColumn("timestamp", F.coalesce("timestamp", late)).filter("timestamp IS NOT NULL"), s)
    # order as text and number of fields that pandas sorts: seq may be a struct
    kind = rows.schema["seq"].dataType
    places = [f"seq.{f.name}" for f in kind.fields] if isinstance(kind, T.StructType) else ["seq"]
    order = [f"_o{i}" for i in range(len(places))]
    rows = rows.withColumns({o: F.col(p) for o, p in zip(order, places)})
    names = [c for c in rows.columns if c not in (*order, "_t", "_pin", "_pin_unit")]
    out = T.StructType([*(rows.schema[c] for c in names), T.StructField("dtype", T.StringType()), T.StructField("var_unit", T.StringType())])

    def step(_: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches)).sort_values(order, kind="stable")
        known = state.get if state.exists else (None, False, False, None)
        nothing = lambda c: t[c].astype(object).where(t[c].notna(), None).to_numpy()
        known, dtypes, units = fold_rows(known, t["_t"].to_numpy(object), nothing("row_unit"))
        state.update(known)
        pin, pin_unit = nothing("_pin"), nothing("_pin_unit")
        yield t[names].assign(dtype=[p if p is not None else d for p, d in zip(pin, dtypes)], var_unit=[p if p is not None else u for p, u in zip(pin_unit, units)])

    return rows.groupBy("variable_name").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def typed(stream: DataFrame, settings: IngestSettings | None = None) -> DataFrame:
    """A stream of raw rows as typed rows: variable_name in place of an id, the four value columns, quality, unit and dtype
    as of each row. An id is a number of order over all variables, which keyed state can't give out: batch registry() does."""
    s = settings or IngestSettings()
    quality = F.lit(QUALITY.index(s.default_quality)).cast("tinyint")
    values = ["value_float", "value_int", "value_str", "value_bool"]
    return R.typed_values(folded(stream, s)).select("seq", "timestamp", "variable_name", *values, quality.alias("quality"), F.col("timestamp_raw").alias("original_timestamp"), "source", "dtype", F.col("var_unit").alias("unit"))


def into_table(stream: DataFrame, path: str, checkpoint: str, settings: IngestSettings | None = None) -> StreamingQuery:
    """Appends what has come to Parquet, typed, and ends; a later call goes on with the same registry from its checkpoint."""
    out = typed(stream, settings).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def variables(typed_rows: DataFrame) -> DataFrame:
    """The registry (id, name, dtype, unit, source) of typed rows that a stream has written."""
    named = typed_rows.select("seq", "variable_name", "dtype", F.col("unit").alias("var_unit"), "source")
    return R.registry(named)
