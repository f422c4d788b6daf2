"""Typing observations in order: the registry of variables as a running fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.functions import normalize as N
from strandline.operators.tables import saved
from strandline.schema import IngestSettings, QUALITY


#: The per-variable table of so many variables is gathered and broadcast (about 200 bytes each); that of more is written
#: and joined like any other.
SMALL_VARIABLES = 20_000


def _pick(values: dict[str, str]) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("variable_name"))


def parsed(raw: DataFrame, s: IngestSettings) -> DataFrame:
    """raw with value, row_unit, the type of the value's text, and what the settings pin."""
    found = F.coalesce(N.unit_part(F.col("value_raw")), F.col("unit_raw") if "unit_raw" in raw.columns else F.lit(None))
    unit = F.coalesce(_pick(s.unit_overrides), found) if s.relabel_only else F.coalesce(found, _pick(s.unit_overrides))
    df = raw.withColumns({"value": N.value_part(F.col("value_raw")), "row_unit": N.canonical_unit(unit)})
    return df.withColumns({"_t": N.infer_type(F.col("value")), "_pin": _pick(s.type_overrides), "_pin_unit": N.canonical_unit(_pick(s.unit_overrides))})


def _profile(df: DataFrame, *more: Column) -> DataFrame:
    """What a variable's rows see of the rows before them, as a few least values of seq: of its first row, its first FLOAT,
    STRING and unit. Aggregates with map-side sums; no order of a variable's rows is made."""
    first = F.min_by(F.when(F.col("row_unit").isNotNull(), F.lit("FLOAT")).otherwise(F.col("_t")), "seq")
    source = F.min_by("source", "seq") if "source" in df.columns else F.lit(None).cast("string")
    return df.groupBy(F.col("variable_name").alias("_v"), *more).agg(
        F.min("seq").alias("_start"),
        first.alias("_first"),
        F.min(F.when(F.col("_t") == "FLOAT", F.col("seq"))).alias("_float"),
        F.min(F.when(F.col("_t") == "STRING", F.col("seq"))).alias("_string"),
        F.min(F.when(F.col("row_unit").isNotNull(), F.struct("seq", "row_unit"))).alias("_unit"),
        F.first("_pin").alias("_pinned"),
        F.first("_pin_unit").alias("_pinned_unit"),
        source.alias("_source"),
    )


def _held(profile: DataFrame, df: DataFrame) -> DataFrame:
    """A profile in the driver's memory if it is small, else as a written table; `_string` without first rows, which never
    widen themselves. They matter only where a unit made the first row FLOAT, so another look at df is rare."""
    spark = df.sparkSession
    rows = profile.limit(SMALL_VARIABLES + 1).collect()
    small = len(rows) <= SMALL_VARIABLES
    held = spark.createDataFrame(rows, profile.schema) if small else saved(profile)
    odd = held.filter((F.col("_string") == F.col("_start")) & (F.col("_first") != "STRING"))
    if odd.limit(1).count():
        starts = odd.select(F.col("_v").alias("_v2"), F.col("_start").alias("_s2"))
        texts = df.filter(F.col("_t") == "STRING").join(F.broadcast(starts) if small else starts, F.col("variable_name").eqNullSafe(F.col("_v2")) & (F.col("seq") > F.col("_s2")))
        later = texts.groupBy("_v2").agg(F.min("seq").alias("_later"))
        later = spark.createDataFrame(later.collect(), later.schema) if small else saved(later)
        held = held.join(later, F.col("_v").eqNullSafe(F.col("_v2")), "left")
        held = held.withColumn("_string", F.when(F.col("_string") == F.col("_start"), F.col("_later")).otherwise(F.col("_string"))).drop("_v2", "_later")
    return F.broadcast(held) if small else held


def _wide(string: Column, float_: Column) -> Column:
    """A type that only widens, given whether a STRING and a FLOAT have been seen since its first row."""
    whole = F.when(string, "STRING").when(float_, "FLOAT").otherwise("INTEGER")
    return F.when(F.col("_first") == "INTEGER", whole).when((F.col("_first") == "FLOAT") & string, "STRING").otherwise(F.col("_first"))


def _seen(df: DataFrame, profile: DataFrame) -> DataFrame:
    """df, joined with its profile, with dtype and var_unit as of each row."""
    since = lambda c: F.coalesce(F.col("seq") >= F.col(c), F.lit(False))
    df = df.join(profile, F.col("variable_name").eqNullSafe(F.col("_v")))
    df = df.withColumns({"_is_text": since("_string"), "_is_float": since("_float"), "_has_unit": since("_unit.seq")})
    dtype = F.coalesce("_pin", _wide(F.col("_is_text"), F.col("_is_float")))
    return df.withColumns({"dtype": dtype, "var_unit": F.coalesce("_pin_unit", F.when(F.col("_has_unit"), F.col("_unit.row_unit")))})


def fold(raw: DataFrame, settings: IngestSettings | None = None) -> DataFrame:
    """raw (seq, variable_name, value_raw, unit_raw) with value, row_unit, dtype and var_unit as of each row.

    A variable's type comes from its first row and only widens: INTEGER to FLOAT to STRING. Its unit is the first one
    seen. One scan gives a row a variable, which the rows of a second scan are joined with, so a variable with very many
    rows is no task of its own."""
    df = parsed(raw, settings or IngestSettings())
    return _seen(df, _held(_profile(df), df)).select(*raw.columns, "value", "row_unit", "dtype", "var_unit")


def registry(folded: DataFrame) -> DataFrame:
    """(id, name, dtype, unit, source): ids from 1 by first row; type and unit as of the last row. Small: a row a variable."""
    source = F.min_by("source", "seq") if "source" in folded.columns else F.lit(None).cast("string")
    one = folded.groupBy("variable_name").agg(F.min("seq").alias("_first"), F.max_by("dtype", "seq").alias("dtype"), F.max_by("var_unit", "seq").alias("unit"), source.alias("source"))
    return one.select(F.row_number().over(W.Window.orderBy("_first", "variable_name")).alias("id"), F.col("variable_name").alias("name"), "dtype", "unit", "source")


def _registry_of(profile: DataFrame) -> DataFrame:
    """The registry after the last row, from the profile alone."""
    dtype = F.coalesce("_pinned", _wide(F.col("_string").isNotNull(), F.col("_float").isNotNull()))
    number = F.row_number().over(W.Window.orderBy("_start", "_v"))
    return profile.select(number.alias("id"), F.col("_v").alias("name"), dtype.alias("dtype"), F.coalesce("_pinned_unit", F.col("_unit.row_unit")).alias("unit"), F.col("_source").alias("source"))


def _late_times(timed: DataFrame) -> DataFrame:
    """timed, where texts that no pattern reads have what the lenient reader makes of them: it sees each distinct text once."""
    texts = timed.filter("timestamp IS NULL").select(F.col("timestamp_raw").alias("_text")).distinct()
    read = texts.withColumn("_late", N.lenient_timestamp("_text")).filter("_late IS NOT NULL")
    rows = read.limit(SMALL_VARIABLES + 1).collect()
    if not rows:
        return timed
    read = F.broadcast(timed.sparkSession.createDataFrame(rows, read.schema)) if len(rows) <= SMALL_VARIABLES else saved(read)
    # texts that are read have no need of the join: their key is null
    unread = F.when(F.col("timestamp").isNull(), F.col("timestamp_raw"))
    return timed.join(read, unread == F.col("_text"), "left").withColumn("timestamp", F.coalesce("timestamp", "_late")).drop("_text", "_late")


def typed_values(seen: DataFrame) -> DataFrame:
    """Rows with value, row_unit, dtype and var_unit, with their four typed columns: values are converted to the variable's
    unit where their own is another."""
    # columns of their own, as each is named many times
    number = seen.withColumn("_number", F.when(F.col("row_unit") != F.col("var_unit"), F.col("value").try_cast("double")))
    turned = N.convert(F.col("_number"), F.col("row_unit"), F.col("var_unit"))
    typed = number.withColumn("_text", F.coalesce(F.when(F.col("_number").isNotNull(), turned.cast("string")), F.col("value")))
    return typed.withColumns(N.coerce(F.col("_text"), F.col("dtype"))).drop("_number", "_text")


def observations(raw: DataFrame, settings: IngestSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, registry) of raw rows; rows whose timestamp can't be read are left out before types are inferred.

    raw is scanned twice, once for the registry and once for the typed rows, which are written as Parquet in the shared
    folder: whatever is asked of them later reads that table, with filters and columns pushed into its scan, and never
    parses texts again. Python is used only for the distinct timestamps that Spark's patterns don't read, if there are any."""
    s = settings or IngestSettings()
    time = N.timestamp(F.col("timestamp_raw"), s.timestamp_format or s.parser.timestamp_format)
    timed = raw.withColumn("timestamp", time)
    df = parsed(timed, s)
    # in one scan: the profile of rows with a time, and whether there are others
    both = _profile(df, F.col("timestamp").isNull().alias("_unread"))
    rows = both.limit(SMALL_VARIABLES + 1).collect()
    both = raw.sparkSession.createDataFrame(rows, both.schema) if len(rows) <= SMALL_VARIABLES else saved(both)
    if both.filter("_unread").limit(1).count():
        timed = _late_times(timed).filter("timestamp IS NOT NULL")
        df = parsed(timed, s)
        profile = _held(_profile(df), df)
    else:
        profile = _held(both.drop("_unread"), df)
    reg = _registry_of(profile)
    seen = _seen(df, profile)
    typed = typed_values(seen)
    quality = F.lit(QUALITY.index(s.default_quality)).cast("tinyint")
    ids = reg.select(F.col("id").alias("variable_id"), F.col("name").alias("_name"))
    out = typed.join(F.broadcast(ids) if len(rows) <= SMALL_VARIABLES else ids, F.col("variable_name") == F.col("_name"))
    values = ["value_float", "value_int", "value_str", "value_bool"]
    return saved(out.select("seq", "timestamp", "variable_id", *values, quality.alias("quality"), F.col("timestamp_raw").alias("original_timestamp"), "source")), reg


def resolved() -> Column:
    """The one value of an observation as a double, null for text."""
    return F.coalesce(F.col("value_bool").cast("int").cast("double"), F.col("value_int").cast("double"), F.col("value_float"), F.col("value_str").try_cast("double"))


def as_text() -> Column:
    return F.coalesce(F.col("value_bool").cast("string"), F.col("value_int").cast("string"), F.col("value_float").cast("string"), F.col("value_str"))
