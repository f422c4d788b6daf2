"""The library's queries over the test tables and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.functions import normalize as N
from strandline.operators import align as A
from strandline.operators import dependence as D
from strandline.operators import knowledge as K
from strandline.operators import lags as L
from strandline.operators import registry as R
from strandline.operators import sinks
from strandline.operators import stats as S
from strandline.operators import theory as T
from strandline.operators.tables import saved, shared_folder, written
from strandline.operators.twin import DigitalTwin, rollout
from strandline.schema import DiscoverySettings, IngestSettings, TheorySettings
from strandline.sources import readers
from strandline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (seq, ts, variable, value): ts in epoch seconds."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), F.col("event_type").alias("variable"), "value")


def types_of(obs: DataFrame) -> list[str]:
    """Names of the variables: a handful by nature."""
    return [r[0] for r in obs.select("variable").distinct().orderBy("variable").collect()]


def event_matrix(spark: SparkSession, sf_dir: str, strategy: str = "forward_fill") -> tuple[DataFrame, list[str]]:
    obs = event_values(spark, sf_dir)
    names = types_of(obs)
    return (A.forward_matrix(obs, names) if strategy == "forward_fill" else A.matrix(A.align(obs, strategy), names)), names


def written_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """event_matrix() written once, for kernels that read it several times."""
    m, names = event_matrix(spark, sf_dir)
    return saved(m), names


OBS = "obs AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, event_type AS variable, value FROM events), cells AS (SELECT DISTINCT o.ts, v.variable FROM (SELECT DISTINCT ts FROM obs) o CROSS JOIN (SELECT DISTINCT variable FROM obs) v), firsts AS (SELECT variable, ts, arg_min(value, seq) AS v FROM obs GROUP BY ALL), lasts AS (SELECT variable, ts, arg_max(value, seq) AS v FROM obs GROUP BY ALL)"
FFILL = f"{OBS}, filled AS (SELECT c.ts, c.variable, l.v AS value FROM cells c ASOF LEFT JOIN lasts l ON c.variable = l.variable AND c.ts >= l.ts)"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw observations: everything is text."""
    e = event_values(spark, sf_dir)
    return e.select("seq", F.col("ts").cast("string").alias("timestamp_raw"), F.col("variable").alias("variable_name"), F.col("value").cast("string").alias("value_raw"), F.lit("events").alias("source"), F.lit(None).cast("string").alias("unit_raw"))


def typed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.observations(raw_events(spark, sf_dir))


#: Variables by first row, and the observations with their ids, as the library numbers them.
IDS = "ids AS (SELECT event_type AS name, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS id FROM events GROUP BY event_type), typed AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, id, name, value FROM events JOIN ids ON name = event_type)"


# --- sources, sinks, normalisation ---------------------------------------------------------------------------------


@query(f"WITH {IDS} SELECT ts AS timestamp, id AS variable_id, name AS variable_name, value, 'MEASURED' AS quality, 'events' AS source FROM typed")
def obs_long(spark, sf_dir):
    """The long export of typed observations."""
    out = sinks.observation_table(*typed_events(spark, sf_dir))
    return out.select("timestamp", "variable_id", "variable_name", F.col("value").cast("double").alias("value"), "quality", "source")


@query(f"WITH {IDS} SELECT ts AS timestamp, id AS variable_id, value FROM typed WHERE value IS NOT NULL")
def obs_sparse(spark, sf_dir):
    return sinks.sparse_table(typed_events(spark, sf_dir)[0]).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {IDS} SELECT ts AS timestamp, id AS variable_id, value FROM typed WHERE id IN (1, 3) AND ts BETWEEN 1704100000 AND 1706000000")
def filter_vars_range(spark, sf_dir):
    some = sinks.selected(typed_events(spark, sf_dir)[0], [1, 3], (1704100000.0, 1706000000.0))
    return sinks.sparse_table(some).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {IDS} SELECT id, name, 'FLOAT' AS dtype, CAST(NULL AS VARCHAR) AS unit, 'events' AS source FROM ids")
def registry_profile(spark, sf_dir):
    return R.registry(R.fold(raw_events(spark, sf_dir)))


@query(f"WITH {IDS}, grid AS (SELECT DISTINCT ts FROM typed WHERE ts BETWEEN 1704200000 AND 1705000000), lasts AS (SELECT id, ts, arg_max(value, seq) AS v FROM typed GROUP BY ALL), c AS (SELECT g.ts, i.id, l.v FROM (SELECT ts, id FROM grid CROSS JOIN ids) g JOIN ids i USING (id) ASOF LEFT JOIN lasts l ON g.id = l.id AND g.ts >= l.ts) SELECT ts AS timestamp, " + ", ".join(f"coalesce(max(v) FILTER (id = (SELECT id FROM ids WHERE name = '{t}')), -1.0) AS {t}" for t in TYPES) + " FROM c GROUP BY ts")
def matrix_export(spark, sf_dir):
    """A state matrix of a range of time, to which earlier values carry forward; what is missing gets a default."""
    return sinks.state_matrix(*typed_events(spark, sf_dir), missing="default", default=-1.0, time_range=(1704200000.0, 1705000000.0))


_CELLS = "SELECT CAST(n_nationkey AS VARCHAR) AS timestamp_raw, 'n_name' AS variable_name, n_name || ', \"x\"' AS value_raw FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'key', CAST(n_regionkey AS VARCHAR) || ' kPa' FROM nation WHERE n_nationkey % 3 <> 0"


@query(_CELLS)
def csv_parse(spark, sf_dir):
    """Several CSV files, each with a header; quoted delimiters and quotes, and blank cells."""
    k = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").select(k.alias("Time"), F.concat("n_name", F.lit(', "x"')).alias("n_name"), F.when(k % 3 != 0, F.concat(F.col("n_regionkey").cast("string"), F.lit(" kPa"))).otherwise("").alias("key"))
    path = written(rows.repartition(4, "Time"), "csv", header="true", quote='"', escape='"')
    return readers.read(spark, path, "csv").select("timestamp_raw", "variable_name", "value_raw")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS timestamp_raw, 'at.region' AS variable_name, CAST(n_regionkey AS VARCHAR) AS value_raw FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'at.first', CASE WHEN n_regionkey = 0 THEN 'True' ELSE 'False' END FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'tags', '[' || n_name || ', a]' FROM nation")
def json_parse(spark, sf_dir):
    """JSON lines with nested objects, booleans, lists and nulls."""
    r = F.col("n_regionkey")
    rows = read(spark, sf_dir, "nation").select(F.struct(r.alias("region"), (r == 0).alias("first"), F.lit(None).cast("string").alias("none")).alias("at"), F.array("n_name", F.lit("a")).alias("tags"), F.struct(F.col("n_nationkey").alias("Timestamp")).alias("meta"))
    return readers.read(spark, written(rows.repartition(3), "json"), "json").select("timestamp_raw", "variable_name", "value_raw")


_NOTES = """
SELECT CAST(c_custkey AS VARCHAR) AS timestamp_raw, 'note' AS variable_name, c_name || chr(10) || 'says "hi", ' || chr(10) || chr(10) || c_mktsegment AS value_raw FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance', 'at "' || CAST(c_nationkey AS VARCHAR) || '"' FROM customer
"""


@query(_NOTES)
def csv_records(spark, sf_dir):
    """CSV files in which quoted cells hold line breaks, delimiters and quotes, and others hold quotes inside."""
    c = read(spark, sf_dir, "customer")
    quoted = F.concat("c_name", F.lit('\nsays ""hi"", \n\n'), "c_mktsegment")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), quoted, F.lit('",at "'), F.col("c_nationkey").cast("string"), F.lit('"'))
    # a header a file: in front of the first of each file's rows
    rows = c.select(line.alias("value"), F.pmod("c_custkey", F.lit(3)).alias("file"), "c_custkey").repartition(3, "file")
    w = W.Window.partitionBy("file").orderBy("c_custkey")
    rows = rows.select(F.when(F.row_number().over(w) == 1, F.concat(F.lit("time,note,balance\n"), "value")).otherwise(F.col("value")).alias("value"), "file")
    return readers.read(spark, _texts(rows, "file"), "csv").select("timestamp_raw", "variable_name", "value_raw")


def _texts(df: DataFrame, by: str) -> str:
    """The path of text files, a folder for each value of a column."""
    path = f"{shared_folder(df.sparkSession)}/strandline-{uuid.uuid4().hex}"
    df.write.partitionBy(by).text(path)
    return f"{path}/*"


_OBJECTS = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS p FROM orders)
SELECT id AS timestamp_raw, 'v.price' AS variable_name, '1.5' AS value_raw FROM o WHERE k % 4 = 0
UNION ALL SELECT id, 'v.t', '3' FROM o WHERE k % 4 = 0
UNION ALL SELECT id, 'time', p FROM o WHERE k % 4 = 1
UNION ALL SELECT id, 'items', '[{"a":' || id || '},[2]]' FROM o WHERE k % 4 = 3
UNION ALL SELECT id, 'ok', 'True' FROM o WHERE k % 4 = 3
"""


@query(_OBJECTS)
def json_records(spark, sf_dir):
    """JSON lines with bad ones between them, whose objects have other types and other names for their time."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    line = (
        F.when(F.col("o_orderkey") % 4 == 0, of('{"time": ', k, ', "v": {"price": 1.50, "t": 3}}'))
        .when(F.col("o_orderkey") % 4 == 1, of('{"v": {"t": ', k, '}, "time": "', F.col("o_orderpriority"), '", "none": null}'))
        .when(F.col("o_orderkey") % 4 == 2, of('{"time": ', k))
        .otherwise(of('{"ts": "', k, '", "items": [{"a": ', k, '}, [2]], "ok": true}'))
    )
    path = written(o.orderBy("o_orderkey").select(line.alias("value")), "text")
    return readers.read(spark, path, "json").select("timestamp_raw", "variable_name", "value_raw")


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS timestamp_raw, 'props.k' AS variable, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(spark, sf_dir):
    d = read(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.struct(F.col("event_id").alias("time")).alias("m"), F.from_json("props", "struct<k:bigint>").alias("props"))
    return readers.json_rows(d).select(F.col("seq.line").alias("event_id"), "timestamp_raw", F.col("variable_name").alias("variable"), F.col("value_raw").alias("value"))


@query("SELECT p_partkey AS seq, 'size' AS variable_name, CAST(p_size AS VARCHAR) AS value_raw FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part")
def kv_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.concat(F.lit("time="), F.col("p_partkey").cast("string"), F.lit(", size="), F.col("p_size").cast("string"), F.lit(', brand="'), F.col("p_brand"), F.lit('"')).alias("value"))
    raw = readers.parse_kv(p)
    return raw.select(F.col("timestamp_raw").cast("bigint").alias("seq"), "variable_name", "value_raw")


@query("WITH t AS (SELECT p_partkey % 5 AS m, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS z, p_brand FROM part) SELECT k AS timestamp_raw, CASE WHEN m < 2 THEN 'Part_size' ELSE 'log_line' END AS variable_name, CASE m WHEN 0 THEN z WHEN 1 THEN z WHEN 2 THEN 'restart of ' || p_brand WHEN 3 THEN 'error code=' || z || ' in module five' ELSE 'job ' || z || ' of queue size: 3 was dropped' END AS value_raw, CASE m WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' END AS unit_raw FROM t")
def text_parse(spark, sf_dir):
    """Lines that state a value, and lines that only look like it."""
    key, size, m = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    said = F.when(m == 0, F.concat(F.lit("Part-size: "), size, F.lit("mm"))).when(m == 1, F.concat(F.lit("Part size changed to "), size, F.lit(" cm"))).when(m == 2, F.concat(F.lit("restart of "), "p_brand"))
    said = said.when(m == 3, F.concat(F.lit("error code="), size, F.lit(" in module five"))).otherwise(F.concat(F.lit("job "), size, F.lit(" of queue size: 3 was dropped")))
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.concat(key, F.lit(" "), said).alias("value"))
    return readers.parse_text(lines).select("timestamp_raw", "variable_name", "value_raw", "unit_raw")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS number, 'kilopascal' AS unit FROM part")
def unit_split(spark, sf_dir):
    t = F.concat(F.col("p_size").cast("string"), F.lit(" kPa"))
    return read(spark, sf_dir, "part").select("p_partkey", N.value_part(t).alias("number"), N.canonical_unit(N.unit_part(t)).alias("unit"))


@query("SELECT p_partkey, round(CAST(p_size AS DOUBLE) * 1000, 6) AS pascals, round((CAST(p_size AS DOUBLE) + 459.67) * 5 / 9, 6) AS kelvins, round(CAST(p_size AS DOUBLE) / 3.6, 6) AS metres_a_second, CAST(p_size AS DOUBLE) AS unchanged FROM part")
def unit_convert(spark, sf_dir):
    v = F.col("p_size").cast("double")
    to = lambda a, b: F.round(N.convert(v, N.canonical_unit(F.lit(a)), N.canonical_unit(F.lit(b))), 6)
    return read(spark, sf_dir, "part").select("p_partkey", to("kPa", "Pa").alias("pascals"), to("degF", "K").alias("kelvins"), to("km/h", "m/s").alias("metres_a_second"), N.convert(v, F.lit("volt"), F.lit("meter")).alias("unchanged"))


@query("WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part) SELECT p_partkey, round(v * 0.44704, 6) AS mph, round(v * 0.3048, 6) AS feet, round(v * 0.0254, 6) AS inches, round(v * 0.45359237, 6) AS pounds, round(v / 1000000, 9) AS milligrams, round(v * 101325, 3) AS atmospheres, round(v / 1000, 6) AS milliamperes FROM t")
def unit_aliases(spark, sf_dir):
    v = F.col("p_size").cast("double")
    to = lambda a, b, n=6: F.round(N.convert(v, N.canonical_unit(F.lit(a)), N.canonical_unit(F.lit(b))), n)
    return read(spark, sf_dir, "part").select("p_partkey", to("mph", "m/s").alias("mph"), to("ft", "m").alias("feet"), to("in", "m").alias("inches"), to("lb", "kg").alias("pounds"), to("mg", "kg", 9).alias("milligrams"), to("atm", "Pa", 3).alias("atmospheres"), to("ma", "A").alias("milliamperes"))


@query("SELECT o_orderkey, true AS iso, true AS slashes, true AS number, false AS words, true AS month FROM orders")
def time_test(spark, sf_dir):
    """Which texts can be read as times; the month's name only by the lenient reader."""
    d = F.col("o_orderdate").cast("timestamp")
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.is_timestamp(F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("iso"), N.is_timestamp(F.date_format(d, "yyyy/MM/dd")).alias("slashes"), N.is_timestamp(F.col("o_orderkey").cast("string")).alias("number"), N.is_timestamp(F.concat(F.lit("order "), "o_orderstatus", F.lit(" x"))).alias("words"), N.is_timestamp(F.date_format(d, "MMMM yyyy")).alias("month"))


@query("WITH t AS (SELECT 'p_size' AS variable, CAST(p_size + 2 AS VARCHAR) AS t FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'price', CAST(p_partkey AS VARCHAR) || '.5' FROM part) SELECT variable, count(*) AS n, CASE WHEN variable = 'p_size' THEN 'INTEGER' WHEN variable = 'price' THEN 'FLOAT' WHEN count(DISTINCT t) < 20 OR count(DISTINCT t) < 0.1 * count(*) THEN 'CATEGORICAL' ELSE 'STRING' END AS kind FROM t GROUP BY variable")
def series_types(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    long = p.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), c.alias("t")) for v, c in (("p_size", (F.col("p_size") + 2).cast("string")), ("p_name", F.col("p_name")), ("p_brand", F.col("p_brand")), ("price", F.concat(F.col("p_partkey").cast("string"), F.lit(".5"))))])))
    aggs = N.infer_series(N.infer_type(F.col("t")), F.col("t"))
    return long.groupBy("variable").agg(*[c.alias(n) for n, c in aggs.items()]).select("variable", "n", N.series_type().alias("kind"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.7 THEN 'OBSERVED' WHEN value / 100 >= 0.45 THEN 'PROBABLE' ELSE 'SPECULATIVE' END AS evidence FROM events WHERE value / 100 >= 0.3")
def evidence_levels(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("confidence"))
    return K.confident(e).select("event_id", S.level(F.col("confidence")).alias("evidence"))


_TYPE = "CASE WHEN trim(t) = '' THEN 'STRING' WHEN lower(trim(t)) IN ('true', 'yes', 'on', '1', 'false', 'no', 'off', '0') THEN 'BOOLEAN' WHEN regexp_full_match(trim(t), '[+-]?\\d+') THEN 'INTEGER' WHEN regexp_full_match(trim(t), '[+-]?(\\d+\\.\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 'FLOAT' WHEN regexp_matches(trim(t), '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}') THEN 'TIMESTAMP' ELSE 'STRING' END"


@query(f"SELECT variable, {_TYPE} AS kind, count(*) AS n FROM (SELECT 'p_size' AS variable, CAST(p_size AS VARCHAR) AS t FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders) GROUP BY ALL")
def infer_type_profile(spark, sf_dir):
    p, o = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders")
    parts = [p.select(F.lit("p_size").alias("variable"), F.col("p_size").cast("string").alias("t")), p.select(F.lit("p_brand"), "p_brand"), o.select(F.lit("o_orderstatus"), "o_orderstatus"), o.select(F.lit("o_orderdate"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))]
    return reduce(DataFrame.union, parts).groupBy("variable", N.infer_type(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


_FOLD_TEXT = "CASE WHEN event_id % 997 = 5 THEN 'n/a?' WHEN event_id % 7 = 3 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END"


@query(f"WITH t AS (SELECT event_id, event_type, {_FOLD_TEXT} AS t FROM events), k AS (SELECT event_id, event_type, {_TYPE} AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM t), f AS (SELECT event_id, event_type, first_value(kind) OVER w AS f, coalesce(bool_or(rn > 1 AND kind = 'FLOAT') OVER w, false) AS sf, coalesce(bool_or(rn > 1 AND kind = 'STRING') OVER w, false) AS ss FROM k WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, CASE f WHEN 'INTEGER' THEN CASE WHEN ss THEN 'STRING' WHEN sf THEN 'FLOAT' ELSE 'INTEGER' END WHEN 'FLOAT' THEN CASE WHEN ss THEN 'STRING' ELSE 'FLOAT' END ELSE f END AS dtype FROM f")
def type_fold(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("variable_name"), F.expr(_FOLD_TEXT.replace("VARCHAR", "STRING")).alias("value_raw"))
    return R.fold(e).select(F.col("seq").alias("event_id"), "dtype")


@query("SELECT o_orderkey, epoch(o_orderdate) AS iso, epoch(date_trunc('day', o_orderdate)) AS slashes, CAST(o_orderkey AS DOUBLE) AS plain FROM orders")
def ts_normalize(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.timestamp(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("iso"), N.timestamp(F.date_format(d, "yyyy/MM/dd")).alias("slashes"), N.timestamp(F.col("o_orderkey").cast("string")).alias("plain"))


@query("SELECT CAST(row_number() OVER (ORDER BY event_type) AS BIGINT) AS rank, event_type AS name, 'FLOAT' AS dtype, 'kelvin' AS unit, count(*) AS n, round(sum(value + 273.15), 4) AS total FROM events GROUP BY event_type")
def ingest_typed(spark, sf_dir):
    """Raw text with units all the way to typed observations with the documented unit override."""
    e = read(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("timestamp_raw"), F.col("event_type").alias("variable_name"), F.concat(F.format_string("%.9f", "value"), F.lit(" C")).alias("value_raw"), F.lit("events").alias("source"), F.lit(None).cast("string").alias("unit_raw"))
    obs, reg = R.observations(raw, IngestSettings(unit_overrides={t: "K" for t in types_of(event_values(spark, sf_dir))}))
    g = obs.groupBy("variable_id").agg(F.count("value_float").alias("n"), F.round(F.sum("value_float"), 4).alias("total")).join(reg, F.col("id") == F.col("variable_id"))
    return g.select(F.row_number().over(W.Window.orderBy("name")).cast("bigint").alias("rank"), "name", "dtype", "unit", "n", "total")


# --- alignment and fills -------------------------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT c.ts, c.variable, f.v AS value FROM cells c LEFT JOIN firsts f USING (ts, variable)")
def align_exact(spark, sf_dir):
    return A.align(event_values(spark, sf_dir), "exact")


@query(f"WITH {FFILL} SELECT * FROM filled")
def align_ffill(spark, sf_dir):
    return A.align(event_values(spark, sf_dir), "forward_fill")


@query(f"WITH {OBS}, n AS (SELECT c.ts, c.variable, p.ts AS pt, p.v AS pv, q.ts AS nt, q.v AS nv FROM cells c ASOF LEFT JOIN lasts p ON c.variable = p.variable AND c.ts > p.ts ASOF LEFT JOIN firsts q ON c.variable = q.variable AND c.ts <= q.ts) SELECT ts, variable, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN ts - pt <= nt - ts THEN pv ELSE nv END AS value FROM n")
def align_nearest(spark, sf_dir):
    return A.align(event_values(spark, sf_dir), "nearest")


@query(f"WITH {OBS}, n AS (SELECT c.ts, c.variable, p.ts AS pt, p.v AS pv, q.ts AS nt, q.v AS nv FROM cells c ASOF LEFT JOIN lasts p ON c.variable = p.variable AND c.ts > p.ts ASOF LEFT JOIN firsts q ON c.variable = q.variable AND c.ts <= q.ts) SELECT ts, variable, round(CASE WHEN nt = ts THEN nv WHEN pt IS NULL THEN NULL WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * (ts - pt) / (nt - pt) END, 6) AS value FROM n")
def align_interpolate(spark, sf_dir):
    return A.align(event_values(spark, sf_dir), "interpolate").withColumn("value", F.round("value", 6))


_DAY = "SELECT user_id, event_id AS ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ts"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


@query(f"SELECT user_id, ts, coalesce(v, 0.5) AS v FROM ({_DAY})")
def fill_default(spark, sf_dir):
    return A.fill(_gappy(spark, sf_dir), ["v"], "default", 0.5)


@query(f"SELECT user_id, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM ({_DAY})")
def fill_ffill(spark, sf_dir):
    return A.fill(_gappy(spark, sf_dir), ["v"], "forward_fill", partition=["user_id"])


@query(f"WITH g AS ({_DAY}), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS nt, first_value(v IGNORE NULLS) OVER f AS nv FROM g WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, ts, round(CASE WHEN v IS NOT NULL THEN v WHEN pt IS NULL OR nt IS NULL THEN NULL ELSE pv + (nv - pv) * (ts - pt) / (nt - pt) END, 6) AS v FROM n")
def fill_interpolate(spark, sf_dir):
    return A.fill(_gappy(spark, sf_dir), ["v"], "interpolate", partition=["user_id"]).withColumn("v", F.round("v", 6))


@query(f"WITH g AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS DOUBLE) AS i FROM ({_DAY})), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv FROM g WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, ts, round(CASE WHEN v IS NOT NULL THEN v WHEN pi IS NULL OR ni IS NULL THEN NULL ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS v FROM n")
def fill_by_index(spark, sf_dir):
    return A.fill(_gappy(spark, sf_dir), ["v"], "interpolate", partition=["user_id"], by_index=True).withColumn("v", F.round("v", 6))


@query(f"SELECT ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM ({_DAY})")
def fill_whole_series(spark, sf_dir):
    """Forward fill over one series, shared by tasks."""
    return A.fill(_gappy(spark, sf_dir).drop("user_id"), ["v"], "forward_fill")


@query(f"SELECT ts, v FROM ({_DAY})")
def fill_leave(spark, sf_dir):
    return A.fill(_gappy(spark, sf_dir).drop("user_id"), ["v"], "leave")


@query(f"WITH {FFILL} SELECT ts, " + ", ".join(f"max(value) FILTER (variable = '{t}') AS {t}" for t in TYPES) + " FROM filled GROUP BY ts")
def state_matrix(spark, sf_dir):
    return A.matrix(A.align(event_values(spark, sf_dir)), TYPES)


@query("SELECT name FROM (SELECT 'o_orderkey' AS name, count(t) AS n, count(try_cast(t AS DOUBLE)) AS k FROM (SELECT CAST(o_orderkey AS VARCHAR) AS t FROM orders) UNION ALL SELECT 'o_totalprice', count(t), count(try_cast(t AS DOUBLE)) FROM (SELECT CAST(o_totalprice AS VARCHAR) AS t FROM orders) UNION ALL SELECT 'o_orderstatus', count(t), count(try_cast(t AS DOUBLE)) FROM (SELECT o_orderstatus AS t FROM orders) UNION ALL SELECT 'mixed', count(t), count(try_cast(t AS DOUBLE)) FROM (SELECT CASE WHEN o_orderkey % 10 < 1 THEN 'n/a' ELSE '1' END AS t FROM orders)) WHERE n = 0 OR k >= 0.8 * n")
def numeric_columns(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")], F.when(F.col("o_orderkey") % 10 < 1, "n/a").otherwise("1").alias("mixed"))
    return spark.createDataFrame([(c,) for c in S.numeric_columns(o)], "name string")


# --- statistics ----------------------------------------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS rows, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def pearson_pairs(spark, sf_dir):
    return S.pair_moments(read(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", F.round("r", 6))


_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT {_RANK.format(c=a)} AS x, {_RANK.format(c=b)} AS y FROM lineitem)" for a, b in _PAIRS))
def spearman_pairs(spark, sf_dir):
    return S.spearman(read(spark, sf_dir, "lineitem"), NUMBERS).withColumn("rho", F.round("rho", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, names = event_matrix(spark, sf_dir)
    return S.pair_moments(m, names).withColumn("r", F.round("r", 6))


_EPAIRS = [(a, b) for i, a in enumerate(TYPES) for b in TYPES[i + 1 :]]
_WIDE = f"{FFILL}, m AS (SELECT ts, " + ", ".join(f"max(value) FILTER (variable = '{t}') AS {t}" for t in TYPES) + " FROM filled GROUP BY ts)"
QUERIES["event_correlation"] = flagship
SQL["event_correlation"] = f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS rows, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM m" for a, b in _EPAIRS)


@query(f"WITH {_WIDE}, z AS (SELECT row_number() OVER (ORDER BY ts) AS i, (click - avg(click) OVER ()) / stddev_pop(click) OVER () AS x, (view - avg(view) OVER ()) / stddev_pop(view) OVER () AS y, count(*) OVER () AS n FROM m WHERE click IS NOT NULL AND view IS NOT NULL) SELECT 'click' AS a, 'view' AS b, any_value(a.n) AS n, CAST(k AS BIGINT) AS lag, round(sum(a.x * b.y) / any_value(a.n), 6) AS r FROM z a, range(-5, 6) t(k), z b WHERE b.i = a.i + k GROUP BY k")
def xcorr_lags(spark, sf_dir):
    """Cross-correlation of two event types at lags -5..5."""
    m = written_matrix(spark, sf_dir)[0]
    return S.cross_correlations(m, "ts", [("click", "view")], 5).select("a", "b", "n", "lag", F.round("r", 6).alias("r"))


_TRIGGERS = f"""
WITH {_WIDE}, p AS (SELECT 'click' AS a, 'view' AS b, ts, click AS x, view AS y FROM m WHERE click IS NOT NULL AND view IS NOT NULL),
d AS (SELECT *, row_number() OVER (ORDER BY ts) - 2 AS i, x - lag(x) OVER (ORDER BY ts) AS dx, y - lag(y) OVER (ORDER BY ts) AS dy FROM p),
s AS (SELECT i, dx, dy, sum(abs(dx)) OVER w AS cx, sum(abs(dy)) OVER w AS cy, count(*) OVER () AS m, stddev_pop(dx) OVER () AS sx, stddev_pop(dy) OVER () AS sy FROM d WHERE i >= 0 WINDOW w AS (ORDER BY i)),
j AS (SELECT true AS forward, i, m FROM s WHERE abs(dx) / (sx + 1e-10) > 2.5 UNION ALL SELECT false, i, m FROM s WHERE abs(dy) / (sy + 1e-10) > 2.5),
g AS (SELECT forward, i, m, least(50, (m + 1) // 4) AS lag, count(*) OVER (PARTITION BY forward) AS jumps FROM j),
w AS (SELECT forward, jumps, m, lag, 'r' AS kind, i + 1 AS start FROM g UNION ALL
  SELECT forward, jumps, m, lag, 'b', ((((3 * i + r + 1) * 2654435761 + 42) % 4294967296) * (m - lag)) // 4294967296 FROM g, range(0, 3) q(r)),
v AS (SELECT forward, jumps, kind, start, least(start + lag, m) AS stop FROM w WHERE start < least(start + lag, m)),
z AS (SELECT forward, jumps, kind, (CASE WHEN forward THEN e.cy - coalesce(f.cy, 0) ELSE e.cx - coalesce(f.cx, 0) END) / (stop - start) AS mean FROM v JOIN s e ON e.i = stop - 1 LEFT JOIN s f ON f.i = start - 1),
q AS (SELECT forward, jumps, avg(mean) FILTER (kind = 'r') AS response, avg(mean) FILTER (kind = 'b') AS baseline FROM z GROUP BY ALL)
SELECT CASE WHEN forward THEN 'click' ELSE 'view' END AS source, CASE WHEN forward THEN 'view' ELSE 'click' END AS target, jumps, round(response, 6) AS response, round(baseline, 6) AS baseline,
  round(response / (baseline + 1e-10), 6) AS ratio, round(least(0.85, greatest(0.0, (response / (baseline + 1e-10) - 1) / 3)), 6) AS confidence
FROM q WHERE jumps >= 3
"""


@query(_TRIGGERS)
def trigger_response(spark, sf_dir):
    """How much larger steps of a variable are behind jumps of another, as discovery scores it."""
    m = written_matrix(spark, sf_dir)[0]
    out = L.trigger_scores(m, "ts", [("click", "view")])
    return out.select("source", "target", "jumps", *[F.round(c, 6).alias(c) for c in ("response", "baseline", "ratio", "confidence")])


@query()
def mutual_information(spark, sf_dir):
    m, names = written_matrix(spark, sf_dir)
    return D.mutual_informations(m, "ts", list(combinations(names, 2))).select("a", "b", "mi")


@query()
def granger_pairs(spark, sf_dir):
    m, names = written_matrix(spark, sf_dir)
    return S.causes(m, "ts", [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], DiscoverySettings(granger_p=1.0))


@query()
def lagged_relations(spark, sf_dir):
    m, names = written_matrix(spark, sf_dir)
    return S.lagged(m, "ts", names, DiscoverySettings(xcorr_min=0.0))


@query()
def threshold_rules(spark, sf_dir):
    m, names = written_matrix(spark, sf_dir)
    return K.rules(m, names)


@query()
def operating_modes(spark, sf_dir):
    m, names = written_matrix(spark, sf_dir)
    found = K.modes(m, "ts", names)
    if found.labels is None:
        return spark.createDataFrame([], "ts double, mode string")
    return found.labels


_MOVES = "SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_mode, event_type AS to_mode FROM events"


@query(f"WITH m AS ({_MOVES}), c AS (SELECT from_mode, to_mode, count(*) AS n FROM m WHERE from_mode <> to_mode GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_mode) AS p FROM c) SELECT from_mode, to_mode, n, round(p, 6) AS probability, round(least(1.0, greatest(0.0, p * ln(1 + n) / 3)), 6) AS confidence FROM p")
def mode_transitions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("mode"))
    return K.transitions(e, "event_id", partition=["user_id"]).withColumns({c: F.round(c, 6) for c in ("probability", "confidence")})


_REL = "(SELECT event_type AS source, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS target, 'INFLUENCES' AS type, CASE WHEN event_id % 5 = 0 THEN 'granger' ELSE 'xcorr' END AS method, value / 1000 AS confidence, CAST(event_id % 4 AS DOUBLE) AS lag, value / 2000 AS lag_confidence, CASE WHEN event_id % 5 = 0 THEN value / 10000 END AS p, 1.0 AS coverage FROM events)"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(i % 2 == 0, "view").otherwise("click").alias("target"), F.lit("INFLUENCES").alias("type"), F.when(i % 5 == 0, "granger").otherwise("xcorr").alias("method"), (F.col("value") / 1000).alias("confidence"), (i % 4).cast("double").alias("lag"), (F.col("value") / 2000).alias("lag_confidence"), F.when(i % 5 == 0, F.col("value") / 10000).alias("p"), F.lit(1.0).alias("coverage"))


@query(f"SELECT source, target, type, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, round(CASE WHEN count(DISTINCT method) > 1 THEN least(max(confidence) + 0.05 * (count(DISTINCT method) - 1), 0.98) ELSE max(confidence) END, 6) AS confidence, round(avg(lag), 6) AS lag, round(min(p), 6) AS p FROM {_REL} GROUP BY ALL")
def merge_relationships(spark, sf_dir):
    return K.merge(_relations(spark, sf_dir)).select("source", "target", "type", F.array_join("methods", ",").alias("methods"), *[F.round(c, 6).alias(c) for c in ("confidence", "lag", "p")])


@query(f"WITH r AS (SELECT DISTINCT source, target, 0.0 AS lag FROM {_REL}) SELECT DISTINCT a.source, a.target, 'low' AS severity FROM r a JOIN r b ON a.source = b.target AND a.target = b.source WHERE a.lag = 0 AND b.lag = 0")
def contradictions_bidirectional(spark, sf_dir):
    return K.bidirectional(_relations(spark, sf_dir).select("source", "target", F.lit(0.0).alias("lag")).distinct())


_FOUND = [("click", "view", "pearson", 0.8), ("click", "view", "spearman", -0.8), ("error", "view", "pearson", -0.7), ("error", "view", "spearman", 0.7), ("purchase", "view", "pearson", 0.6), ("signup", "view", "mutual_information", 0.5)]
_FIND = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{m}', CAST({v} AS DOUBLE))" for a, b, m, v in _FOUND if m != "mutual_information") + ") f(a, b, metric, value))"


def _found(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FOUND, "a string, b string, metric string, value double")


@query(f"WITH r AS (SELECT event_type AS source, 'view' AS target, avg(value) - 50 AS peak FROM events WHERE event_type <> 'view' GROUP BY ALL) SELECT source, target, metric, round(value, 6) AS correlation, round(peak, 6) AS peak, 'medium' AS severity FROM r JOIN {_FIND} f ON least(source, target) = a AND greatest(source, target) = b WHERE sign(peak) <> sign(value)")
def contradictions_sign(spark, sf_dir):
    r = read(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("source")).agg((F.avg("value") - 50).alias("value")).select("source", F.lit("view").alias("target"), "value", F.lit("cross_correlation").alias("method"))
    return K.sign_conflicts(_found(spark), r).withColumns({c: F.round(c, 6) for c in ("correlation", "peak")})


_RULES = "SELECT event_type AS target, 'view' AS variable, CASE WHEN sum(event_id) % 2 = 0 THEN '>' ELSE '<=' END AS operator, CASE WHEN count(*) % 2 = 0 THEN 'increase' ELSE 'decrease' END AS direction FROM events WHERE event_type <> 'view' GROUP BY ALL"


@query(f"WITH r AS ({_RULES}), f AS (SELECT a, b, max(metric) AS metric, arg_max(value, metric) AS value FROM {_FIND} GROUP BY ALL) SELECT target, variable, metric, 'medium' AS severity FROM r JOIN f ON least(target, variable) = a AND greatest(target, variable) = b WHERE ((operator = '>') = (direction = 'increase')) <> (value > 0)")
def contradictions_rules(spark, sf_dir):
    """Rules of one condition against the sign of the pair's last correlation; one of two conditions doesn't count."""
    e = read(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("target")).agg(F.sum("event_id").alias("s"), F.count("*").alias("n"))
    one = F.struct(F.lit("view").alias("variable"), F.when(F.col("s") % 2 == 0, ">").otherwise("<=").alias("operator"), F.lit(1.0).alias("threshold"))
    way = F.when(F.col("n") % 2 == 0, "increase").otherwise("decrease")
    rules = e.select("target", F.array(one).alias("conditions"), way.alias("direction")).union(e.select("target", F.array(one, one), F.lit("increase")))
    return K.rule_conflicts(_found(spark), rules)


_CENTRE = "SELECT l_returnflag AS label, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL"


@query(f"WITH c AS ({_CENTRE}) SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, (SELECT arg_min(c.label, ((l.l_quantity - c.l_quantity) ** 2 + (l.l_extendedprice - c.l_extendedprice) ** 2, c.label)) FROM c) AS label FROM lineitem l")
def nearest_centroid(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("label")).agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_extendedprice").alias("l_extendedprice"))
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", "l_extendedprice")
    return T.nearest_centroid(rows, c, ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "label")


_STUMP = "SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY ALL"


@query("WITH vals AS (" + " UNION ALL ".join(_STUMP.format(c=c) for c in ("l_quantity", "l_discount")) + "), w AS (SELECT variable, v, lead(v) OVER o AS nx, sum(n) OVER r AS ln, sum(k) OVER r AS lk, sum(n) OVER p AS tn, sum(k) OVER p AS tk FROM vals WINDOW o AS (PARTITION BY variable ORDER BY v), r AS (PARTITION BY variable ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY variable)), g AS (SELECT variable, (v + nx) / 2 AS threshold, round((2.0 * lk * (ln - lk) / ln + 2.0 * (tk - lk) * (tn - ln - tk + lk) / (tn - ln)) / tn, 12) AS gini FROM w WHERE nx IS NOT NULL) SELECT variable, round(arg_min(threshold, (gini, threshold)), 6) AS threshold, round(min(gini), 6) AS gini FROM g GROUP BY variable")
def stump_trigger(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return T.stump(li, ["l_quantity", "l_discount"]).select("variable", F.round("threshold", 6).alias("threshold"), F.round("gini", 6).alias("gini"))


_EDGES = f"e AS (SELECT from_mode AS a, to_mode AS b, count(*) AS n FROM ({_MOVES}) WHERE from_mode <> to_mode GROUP BY ALL)"


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT [a, b] AS path, n AS weakest FROM e UNION ALL SELECT list_append(path, b), least(weakest, n) FROM walk JOIN e ON path[-1] = a WHERE NOT list_contains(path, b) AND len(path) <= 4) SELECT array_to_string(path, '>') AS path, round(0.5 + weakest / 1e6, 9) AS confidence, CAST(len(path) - 1 AS DOUBLE) AS lag FROM walk WHERE len(path) = 5 ORDER BY 0.5 + weakest / 1e6 DESC, path LIMIT 12")
def influence_chains(spark, sf_dir):
    """The surest simple paths in the graph of event types, which has a node a type."""
    return spark.createDataFrame([(">".join(c["path"]), round(c["confidence"], 9), c["lag"]) for c in T.chains(_event_edges(spark, sf_dir))], "path string, confidence double, lag double")


def _event_edges(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], dict]:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("mode"))
    moves = K.transitions(e, "event_id", partition=["user_id"]).collect()
    rows = [{"source": m.from_mode, "target": m.to_mode, "type": "INFLUENCES", "confidence": 0.5 + m.n / 1e6, "lag": 1.0} for m in moves]
    # too unsure to count
    return T.edges_of([*rows, {"source": "click", "target": "nowhere", "type": "INFLUENCES", "confidence": 0.39, "lag": 0.0}], {("click", "view"): -1}, TheorySettings())


@query(f"WITH RECURSIVE {_EDGES}, walk AS (SELECT [a, b] AS path, n AS total, CASE WHEN least(a, b) = 'click' AND greatest(a, b) = 'view' THEN -1 ELSE 1 END AS sign FROM e WHERE b > a UNION ALL SELECT list_append(path, b), total + n, sign * CASE WHEN least(a, b) = 'click' AND greatest(a, b) = 'view' THEN -1 ELSE 1 END FROM walk JOIN e ON path[-1] = a WHERE NOT list_contains(path, b) AND b > path[1] AND len(path) < 5) SELECT array_to_string(path, '>') AS path, round(0.5 + (total + n) / 1e6 / len(path), 9) AS confidence, CASE WHEN sign * CASE WHEN least(a, b) = 'click' AND greatest(a, b) = 'view' THEN -1 ELSE 1 END > 0 THEN 'positive' ELSE 'negative' END AS polarity FROM walk JOIN e ON path[-1] = a AND path[1] = b")
def feedback_loops(spark, sf_dir):
    found = T.loops(_event_edges(spark, sf_dir))
    return spark.createDataFrame([(">".join(x["path"]), round(x["confidence"], 9), x["polarity"]) for x in found], "path string, confidence double, polarity string")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(1 - abs(corr({a}, {b})), 6) AS distance FROM lineitem" for a, b in _PAIRS))
def variable_distances(spark, sf_dir):
    """Distances that subsystems are clustered by."""
    d = T.distances(NUMBERS, S.pair_moments(read(spark, sf_dir, "lineitem"), NUMBERS).collect())
    return spark.createDataFrame([(NUMBERS[i], NUMBERS[j], float(round(d[i, j], 6))) for i in range(len(NUMBERS)) for j in range(i + 1, len(NUMBERS))], "a string, b string, distance double")


@query(f"WITH {_WIDE}, l AS (SELECT view AS y, lag(click, 3) OVER (ORDER BY ts) AS x FROM m), k AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL) SELECT 'view' AS target, 'click' AS source, CAST(3 AS BIGINT) AS lag, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 8) AS r2 FROM k")
def ols_single(spark, sf_dir):
    """A regression of one event type on another, three rows earlier."""
    m = written_matrix(spark, sf_dir)[0]
    (e,) = T.equations(m, "ts", {("click", "view"): {"confidence": 0.9, "lag": 3.0, "sign": 1}}, [], TheorySettings(min_r2=-1.0, max_degree=1))
    return spark.createDataFrame([(e["target"], e["sources"][0], e["lags"][0], round(e["coef"][0], 6), round(e["intercept"], 5), round(e["r2"], 8))], "target string, source string, lag bigint, slope double, intercept double, r2 double")


@query("SELECT round(regr_slope(p, q), 6) AS slope, round(regr_intercept(p, q), 3) AS intercept, round(regr_r2(p, q), 6) AS r2 FROM (SELECT avg(l_extendedprice) AS p, avg(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def centroid_fit(spark, sf_dir):
    """A regression on the centroids of a few modes."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("p"), F.avg("l_quantity").alias("q")).collect()
    (e,) = T.equations(spark.createDataFrame([], "ts double"), "ts", {("q", "p"): {"confidence": 0.9, "lag": 0.0, "sign": 1}}, [{"centroid": {"p": r.p, "q": r.q}} for r in rows], TheorySettings(min_r2=-1.0))
    return spark.createDataFrame([(round(e["coef"][0], 6), round(e["intercept"], 3), round(e["r2"], 6))], "slope double, intercept double, r2 double")


@query("WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_tax) AS mz, avg(l_extendedprice) AS mp, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_discount, l_discount) AS yy, covar_pop(l_discount, l_tax) AS yz, covar_pop(l_tax, l_tax) AS zz, covar_pop(l_quantity, l_extendedprice) AS xp, covar_pop(l_discount, l_extendedprice) AS yp, covar_pop(l_tax, l_extendedprice) AS zp FROM lineitem), c AS (SELECT *, (xp*(yy*zz-yz*yz)-xy*(yp*zz-yz*zp)+xz*(yp*yz-yy*zp))/(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz)) AS b_x, (xx*(yp*zz-yz*zp)-xp*(xy*zz-yz*xz)+xz*(xy*zp-yp*xz))/(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz)) AS b_y, (xx*(yy*zp-yp*yz)-xy*(xy*zp-yp*xz)+xp*(xy*yz-yy*xz))/(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz)) AS b_z FROM m) SELECT 'intercept' AS term, round(mp - b_x * mx - b_y * my - b_z * mz, 3) AS coefficient FROM c UNION ALL SELECT 'l_quantity', round(b_x, 3) FROM c UNION ALL SELECT 'l_discount', round(b_y, 3) FROM c UNION ALL SELECT 'l_tax', round(b_z, 3) FROM c")
def ols_multiple(spark, sf_dir):
    """A regression with three predictors from sums of products of the whole table."""
    xs = ["l_quantity", "l_discount", "l_tax"]
    fit = T.ols_gram(*T.gram(read(spark, sf_dir, "lineitem"), xs, "l_extendedprice"))
    return spark.createDataFrame([(x, float(round(c, 3))) for x, c in zip(["intercept", *xs], [fit["intercept"], *fit["coef"]], strict=True)], "term string, coefficient double")


@query("SELECT round(median(d), 6) AS dt FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1e6 AS d FROM events)")
def dt_median(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return spark.createDataFrame([(round(T.median_step(e, "ts", ["event_id"]), 6),)], "dt double")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type AS variable, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_max(value, ts) AS last FROM events GROUP BY ALL")
def hourly_summaries(spark, sf_dir):
    """What the stream's windows give for a table that is there as a whole."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("variable"), "value")
    out = ingest.summaries(e).withColumn("mean", F.round("mean", 6))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH RECURSIVE s AS (SELECT CAST(n_nationkey AS BIGINT) AS scenario, 0 AS step, CAST(n_nationkey AS DOUBLE) AS u, 0.0::DOUBLE AS y FROM nation UNION ALL SELECT scenario, step + 1, u, 0.5 * y + u FROM s WHERE step < 20) SELECT scenario, CAST(step AS BIGINT) AS step, round(y, 6) AS y FROM s WHERE step > 0")
def twin_rollout(spark, sf_dir):
    """y follows 0.5 y + u, twenty steps for each nation's input u."""
    twin = DigitalTwin(["u", "y"], [{"target": "y", "sources": ["u", "y"], "lags": [0, 0], "kind": "linear", "intercept": 0.0, "coef": [1.0, 0.5]}], [], [])
    inputs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("scenario"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("step"), F.col("n_nationkey").cast("double").alias("u"))
    return rollout(inputs, twin).select("scenario", "step", F.round("y", 6).alias("y"))


@query()
def discovered_model(spark, sf_dir):
    """End to end: matrix, discovery, theory; a row for each thing found."""
    m, _ = written_matrix(spark, sf_dir)
    model = K.discover(m, "ts")
    t = T.synthesize(model, m)
    rows = [("finding", f"{f['a']}|{f['b']}|{f['metric']}", float(f["confidence"])) for f in model.findings] + [("relation", f"{r['source']}|{r['target']}|{r['type']}", float(r["confidence"])) for r in model.relations]
    rows += [("rule", K.rule_text(r), float(r["confidence"])) for r in model.rules] + [("mode", x["label"], float(x["prevalence"])) for x in model.modes] + [("subsystem", x["name"], float(np.round(x["coherence"], 6))) for x in t.subsystems] + [("equation", e["target"], float(e["r2"])) for e in t.equations]
    return spark.createDataFrame(rows, "kind string, name string, confidence double")
