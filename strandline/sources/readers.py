"""Sources: CSV and TSV, JSON and JSONL, key=value lines and free text to raw observations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from strandline.functions.normalize import NUMBER, unit_part, value_part
from strandline.schema import ParserSettings, RAW, TIME_NAMES

EXTENSIONS: dict[str, str] = {}

#: parse(spark, source, settings) to raw rows, by name of format.
Parse = Callable[[SparkSession, str, ParserSettings], DataFrame]
PARSERS: dict[str, Parse] = {}


def register_parser(name: str, parse: Parse, extensions: tuple[str, ...] = ()) -> None:
    """Adds a format: read() finds it by name and by extension. parse returns the columns of schema.RAW."""
    PARSERS[name.lower()] = parse
    for x in extensions:
        EXTENSIONS[x.lower().lstrip(".")] = name.lower()


def _numbered(df: DataFrame, of_file: bool = True) -> DataFrame:
    """df with where a row comes from: file, first byte of its split, and a number that increases inside a split."""
    if not of_file:
        return df.select("*", F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


#: What is cut off around a value.
_BLANKS = " \t\n\r\x0b\x0c"


def _raw(df: DataFrame, time: Column, pairs: Column, source: str, unit: Column | None = None) -> DataFrame:
    """Raw observations of lines; pairs is array<struct<name, value>>, blank values fall away."""
    file, start = (F.col(c) if c in df.columns else F.lit(d).cast(t) for c, d, t in (("file", "", "string"), ("start", 0, "bigint")))
    out = df.select(file.alias("_file"), start.alias("_start"), F.col("line").cast("bigint").alias("_line"), time.alias("timestamp_raw"), F.posexplode(pairs).alias("_k", "_p"), (unit if unit is not None else F.lit(None).cast("string")).alias("unit_raw"))
    out = out.withColumn("_v", F.btrim(F.col("_p.value"), F.lit(_BLANKS))).filter(F.col("_v") != "")
    seq = F.struct(F.col("_file").alias("source"), F.col("_start").alias("start"), F.col("_line").alias("line"), F.col("_k").alias("place"))
    return out.select(seq.alias("seq"), "timestamp_raw", F.col("_p.name").alias("variable_name"), F.col("_v").alias("value_raw"), F.lit(source).alias("source"), "unit_raw")


def _time_place(names: list[str], settings: ParserSettings) -> int:
    """Which of the header's names is the time: the one of the settings, else the first that is named as one, else the first."""
    if not settings.timestamp_column:
        return next((i for i, x in enumerate(names) if x.lower() in TIME_NAMES), 0)
    if settings.timestamp_column not in names:
        raise ValueError(f"no column {settings.timestamp_column}")
    return names.index(settings.timestamp_column)


def _cells(names: list[str], columns: list[Column], at: int) -> Column:
    """Names and values of a row's cells but for the time's; cells without a name fall away."""
    named = [(n, c) for i, (n, c) in enumerate(zip(names, columns, strict=True)) if i != at and n]
    return F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in named])


def read_csv(spark: SparkSession, path: str, settings: ParserSettings | None = None) -> DataFrame:
    """A row a cell of a CSV or TSV file, or of all files of a path: these share one header, which each of them has in its
    first record (one with another header is an error, unless names are blank or repeated: then the first file's count).

    Quoted cells may hold line breaks, wherever Spark splits the file. A scan of the lines tells whether any record goes
    beyond its line; only then are lines put together, see csv_records()."""
    s = settings or ParserSettings()
    sep = "\t" if path.lower().endswith(".tsv") and s.delimiter == "," else s.delimiter
    lines = _numbered(spark.read.option("encoding", s.encoding).text(path))
    # while each line that starts outside quotes ends outside them, all lines do
    if lines.filter(F.contains("value", F.lit('"')) & (_inside(F.col("value"), sep, False) == 1)).limit(1).count():
        return _csv_of_records(csv_records(lines, sep), s, sep, path)
    reader = lambda: spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", s.encoding)
    plain = reader().csv(path)
    head = plain.filter(F.col("_metadata.file_block_start") == 0).select(*plain.columns).first()
    if head is None:
        return spark.createDataFrame([], RAW)
    raw = [x or "" for x in head]
    names = [x.strip() for x in raw]
    at = _time_place(names, s)
    distinct = all(names) and len({x.lower() for x in raw}) == len(raw)
    columns = raw if distinct else plain.columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    body = reader().schema(schema).option("header", True).option("enforceSchema", not distinct).csv(path)
    body = _numbered(body).toDF(*plain.columns, "file", "start", "line")
    return _raw(body, F.col(plain.columns[at]), _cells(names, [F.col(c) for c in plain.columns], at), path)


def _inside(line: Column, sep: str, before: bool) -> Column:
    """1 if a line of CSV ends inside a quoted cell, given whether it starts in one; else 0.

    A quote opens a cell at the cell's first character only; inside, a doubled quote is a quote. The line is taken apart at
    its quotes. States: 0 outside, 1 inside, 2 behind a quote that may close the cell or be the first of two."""

    def opens(part: Column, i: Column) -> Column:
        return F.when(part == "", (i == 0).cast("int")).otherwise(F.endswith(part, F.lit(sep)).cast("int"))

    def state(parts: Column) -> Column:
        # what stands in front of each quote
        ahead = F.slice(F.transform(parts, lambda p, i: F.struct((p == "").alias("empty"), opens(p, i).alias("opens"))), F.lit(1), F.size(parts) - 1)
        return F.aggregate(ahead, F.lit(int(before)), lambda acc, p: F.when(acc == 1, 2).when((acc == 2) & p["empty"], 1).otherwise(p["opens"]))

    return F.when(~F.contains(line, F.lit('"')), int(before)).otherwise((_once(F.split(line, '"', -1), state) == 1).cast("int"))


def csv_records(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Records of CSV lines (file, start, line, value): the same columns, where a record has the place of its first line, and
    `head`: is it the file's first? Lines of one record are joined by a line break.

    What a line does to being inside quotes is one of four maps: it keeps the state, swaps it, or sets it to either. So the
    state in front of each line follows from running sums inside its split and one summary row a split; no file is read by
    one task. A record is put together from its own lines only; a quote that never closes makes the rest of its file one."""
    sets, swaps = F.col("_out") == F.col("_in"), (F.col("_out") == 1) & (F.col("_in") == 0)
    df = lines.withColumns({"_out": _inside(F.col("value"), sep, False), "_in": _inside(F.col("value"), sep, True)})
    split = W.Window.partitionBy("file", "start").orderBy("line")
    ahead, up_to = (split.rowsBetween(W.Window.unboundedPreceding, n) for n in (-1, 0))
    df = df.withColumn("_swaps", (F.sum(swaps.cast("int")).over(up_to) % 2).cast("int"))
    # the state that the last line that sets it would have had at the split's start, had it been swapped since
    df = df.withColumn("_set", F.when(sets, F.col("_out").bitwiseXOR(F.col("_swaps"))))
    df = df.withColumns({"_last": F.last("_set", True).over(ahead), "_swapped": F.coalesce(F.lag("_swaps").over(split), F.lit(0)), "_nth": F.row_number().over(split)})
    ends = df.groupBy("file", "start").agg(F.max_by("_swaps", "line").alias("_s"), F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("line"))).alias("_c"))
    # the state in front of a split: from the last split that sets it, swapped as often as splits swapped since
    file = W.Window.partitionBy("_f").orderBy("_b")
    before = file.rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.toDF("_f", "_b", "_s", "_c").withColumn("_total", (F.sum("_s").over(file) % 2).cast("int"))
    ends = ends.withColumn("_at", F.col("_c").bitwiseXOR(F.col("_total")).bitwiseXOR(F.col("_s")))
    known = F.coalesce(F.last("_at", True).over(before), F.lit(0))
    ends = ends.select("_f", "_b", known.bitwiseXOR(F.coalesce(F.lag("_total").over(file), F.lit(0))).alias("_enters"))
    df = df.join(ends, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_b"))).drop("_f", "_b")
    df = df.withColumn("_state", F.coalesce("_last", "_enters").bitwiseXOR(F.col("_swapped")))
    df = df.withColumn("_first", F.last(F.when(F.col("_state") == 0, F.struct("start", "line")), True).over(up_to))
    # lines in front of a split's first record belong to the last record of the splits before
    firsts = df.groupBy(F.col("file").alias("_f"), F.col("start").alias("_b")).agg(F.max(F.when(F.col("_state") == 0, F.struct("start", "line"))).alias("_m"))
    firsts = firsts.select("_f", "_b", F.last("_m", True).over(before).alias("_earlier"))
    df = df.join(firsts, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_b")))
    after = F.when(F.col("_state") == 0, F.col("_out")).otherwise(F.col("_in"))
    head = (F.col("start") == 0) & (F.col("_nth") == 1)
    df = df.select("file", F.coalesce("_first", "_earlier").alias("_record"), "start", "line", "value", head.alias("head"), ((F.col("_state") == 0) & (after == 0)).alias("_alone"))
    whole = df.filter("_alone").select("file", "start", "line", "value", "head")
    parts = df.filter("not _alone").groupBy("file", "_record").agg(F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("p"), F.max("head").alias("head"))
    joined = F.array_join(F.transform("p", lambda x: x["value"]), "\n")
    return whole.unionByName(parts.select("file", F.col("_record.start").alias("start"), F.col("_record.line").alias("line"), joined.alias("value"), "head"))


def _csv_of_records(records: DataFrame, settings: ParserSettings, sep: str, path: str) -> DataFrame:
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    first = records.filter("head").groupBy("value").agg(F.min("file").alias("file")).orderBy("file")
    heads = [r["value"] for r in first.limit(2).collect()]
    if not heads:
        return records.sparkSession.createDataFrame([], RAW)

    def split(text: Column, n: int) -> Column:
        return F.from_csv(text, ", ".join(f"c{i} string" for i in range(n)), options)

    width = heads[0].count(sep) + 1
    cells = records.sparkSession.createDataFrame([(heads[0],)], "h string").select(split(F.col("h"), width).alias("h")).select("h.*").first()
    names = [(x or "").strip() for x in cells]
    while len(names) > 1 and not names[-1] and cells[len(names) - 1] is None:
        names.pop()
    distinct = all(names) and len({x.lower() for x in names}) == len(names)
    if len(heads) > 1 and distinct:
        raise ValueError(f"files of {path} have different headers")
    at = _time_place(names, settings)
    body = records.filter("not head").withColumn("_c", split(F.col("value"), len(names)))
    return _raw(body, F.col(f"_c.c{at}"), _cells(names, [F.col(f"_c.c{i}") for i in range(len(names))], at), path)


#: Python's texts for numbers that JSON has no name for.
_ODD_NUMBERS = {'"NaN"': "nan", '"Infinity"': "inf", '"-Infinity"': "-inf"}
_JSON = {"allowSingleQuotes": "false"}


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _last_of_equal(entries: Column) -> Column:
    """Entries by name, of which the last of equal names counts, at the place of the first."""
    name = lambda e: e["name"]
    newest = lambda es, n: F.element_at(F.filter(es, lambda e: name(e) == n), -1)
    thin = lambda es: F.transform(F.array_distinct(F.transform(es, name)), lambda n: newest(es, n))
    return _once(entries, lambda es: F.when(F.size(F.array_distinct(F.transform(es, name))) == F.size(es), es).otherwise(thin(es)))


def _members(raw: Column, prefix: Column) -> Column:
    """The members of a JSON object in their own order, as (name, raw, kind): raw is the text of a nested value."""
    texts = F.map_entries(F.from_json(raw, "map<string,string>", _JSON))
    kinds = F.map_values(F.from_json(raw, "map<string,variant>", _JSON))
    pair = lambda e, v: F.struct(F.concat(prefix, e["key"]).alias("name"), e["value"].alias("raw"), F.substring(F.schema_of_variant(v), 1, 6).alias("kind"))
    return _last_of_equal(F.zip_with(texts, kinds, pair))


def _listed(raw: Column) -> Column:
    """A JSON list as text: scalars in brackets, True, False and None as Python shows them; lists that hold objects or lists
    as JSON."""
    kinds = F.transform(F.from_json(raw, "array<variant>", _JSON), lambda v: F.substring(F.schema_of_variant(v), 1, 6))
    shown = F.zip_with(F.from_json(raw, "array<string>", _JSON), kinds, lambda x, k: F.when(x.isNull(), "None").otherwise(_scalar(x, k)))
    return _once(kinds, lambda ks: F.when(F.exists(ks, lambda k: k.isin("OBJECT", "ARRAY<")), raw).otherwise(F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))))


def _scalar(raw: Column, kind: Column) -> Column:
    odd = F.create_map(*[F.lit(x) for kv in _ODD_NUMBERS.items() for x in kv])
    return F.when(kind == "BOOLEA", F.initcap(raw)).otherwise(F.coalesce(F.try_element_at(odd, raw), raw))


def json_leaves(text: Column) -> Column:
    """Leaves of a JSON object's text as array<struct<name, value>>, in the text's own order, by dotted names; null if the
    text isn't one object. Types are those of each value, so nothing is inferred over rows; objects may nest to any depth.

    Booleans are True and False, lists as in _listed(), numbers with an exponent as Spark shows them, a repeated name has its
    last value, null has no leaf."""
    # inside brackets, as what stands behind an object would be passed over
    only = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _JSON)
    is_object = F.startswith(F.ltrim(text), F.lit("{")) & (F.size(only) == 1) & F.get(only, F.lit(0)).isNotNull()
    nested = lambda es: F.exists(es, lambda e: e["kind"] == "OBJECT")
    opened = lambda e: F.when(e["kind"] == "OBJECT", _members(e["raw"], F.concat(e["name"], F.lit(".")))).otherwise(F.array(e))
    # no deeper than there are brackets; once nothing is nested, a turn does nothing
    turns = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))), F.lit(1)))
    flat = F.aggregate(turns, _members(text, F.lit("")), lambda es, _: F.when(nested(es), F.flatten(F.transform(es, opened))).otherwise(es))
    value = lambda e: F.when(e["kind"] == "ARRAY<", _listed(e["raw"])).otherwise(_scalar(e["raw"], e["kind"]))
    shown = F.transform(F.filter(flat, lambda e: e["raw"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), value(e).alias("value")))
    return F.when(is_object, shown)


def parse_json(records: DataFrame, settings: ParserSettings | None = None, source: str = "json") -> DataFrame:
    """Raw observations of rows whose `value` is the text of a JSON object (with `line`, and `file` and `start` if they are
    from files); other rows are passed over. A row's time is its first leaf that is named as one, in the row's own order."""
    s = settings or ParserSettings()
    df = records.withColumn("_leaves", json_leaves(F.col("value"))).filter(F.col("_leaves").isNotNull())
    return _raw(df.withColumn("_time", _first_time(F.col("_leaves"), s)), F.col("_time.value"), _others(F.col("_leaves"), F.col("_time.name")), source)


def _first_time(leaves: Column, settings: ParserSettings) -> Column:
    named = settings.timestamp_column
    is_time = (lambda e: e["name"] == named) if named else (lambda e: F.lower(F.element_at(F.split(e["name"], r"\."), -1)).isin(*TIME_NAMES))
    return F.get(F.filter(leaves, is_time), F.lit(0))


def _others(leaves: Column, name: Column) -> Column:
    return _once(name, lambda n: F.filter(leaves, lambda e: ~e["name"].eqNullSafe(n)))


#: A document is read as one value, which Spark can't hold beyond two gigabytes; larger files are read by lines.
DOCUMENT_BYTES = 1 << 30


def read_json(spark: SparkSession, path: str, settings: ParserSettings | None = None) -> DataFrame:
    """Objects of JSON files. `.jsonl`: one a line. Else a file is one document (a list of objects, or one object) if it
    parses as one, and lines otherwise. Lines and items that aren't objects are passed over, the others stay.

    A file whose first line is an object on its own, with more lines behind it, can't be a document; only files of another
    first line are looked at whole, a file a row. Lines are read in parallel, whatever the size of their file."""
    s = settings or ParserSettings()
    reader = spark.read.option("encoding", s.encoding)
    lines = _numbered(reader.text(path))
    if path.lower().endswith(".jsonl"):
        return parse_json(lines, s, path)
    begins = lines.filter((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "line").alias("value"))
    odd = begins.filter(json_leaves(F.col("value")).isNull() & F.trim("value").rlike(r"^[\[{]")).select("file")
    small = spark.read.format("binaryFile").load(path).filter(F.col("length") <= DOCUMENT_BYTES).select(F.col("path").alias("file"))
    whole = [r["file"] for r in odd.join(small, "file", "left_semi").collect()]
    if not whole:
        return parse_json(lines, s, path)
    place = lambda df: df.select("value", F.col("_metadata.file_path").alias("file"))
    texts = place(reader.text(whole, wholetext=True)).withColumn("_list", F.from_json("value", "array<variant>", _JSON))
    is_list = F.startswith(F.ltrim("value"), F.lit("[")) & F.col("_list").isNotNull()
    one = json_leaves(F.col("value")).isNotNull()
    # a document's items as texts of their own; those that aren't objects are told by their text later
    items = F.when(is_list, F.from_json("value", "array<string>", _JSON)).when(one, F.array("value")).otherwise(F.split("value", r"\r\n|\n|\r"))
    kinds = F.when(is_list, F.transform("_list", lambda v: F.substring(F.schema_of_variant(v), 1, 6) == "OBJECT"))
    placed = F.transform(items, lambda x, i: F.struct(i.cast("bigint").alias("line"), x.alias("value"), F.coalesce(F.get(kinds, i), F.lit(True)).alias("ok")))
    records = texts.select("file", F.lit(0).cast("bigint").alias("start"), F.inline(placed)).filter("ok").drop("ok")
    rest = lines.filter(~F.col("file").isin(whole)).select("file", "start", "line", "value")
    return parse_json(rest.unionByName(records), s, path)


def flat_pairs(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Dotted names and texts of a struct's leaves: booleans as True and False, arrays in brackets, of structs as JSON."""
    out = []
    for f in schema.fields:
        name, c = f"{prefix}{f.name}", F.col(".".join(f"`{x}`" for x in f"{prefix}{f.name}".split(".")))
        if isinstance(f.dataType, T.StructType):
            out += flat_pairs(f.dataType, f"{name}.")
        elif isinstance(f.dataType, T.BooleanType):
            out.append((name, F.initcap(c.cast("string"))))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            out.append((name, F.to_json(c)))
        elif isinstance(f.dataType, T.ArrayType):
            out.append((name, F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))))
        else:
            out.append((name, c.cast("string")))
    return out


def json_rows(df: DataFrame, settings: ParserSettings | None = None, source: str = "json") -> DataFrame:
    """Raw observations of structured rows (with `line`, and `file` and `start` if they are from files): leaves by dotted
    names. A row's time is its first leaf with a value that is named as one, in order of the schema."""
    s = settings or ParserSettings()
    leaves = flat_pairs(T.StructType([f for f in df.schema.fields if f.name not in ("file", "start", "line")]))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in leaves]), lambda e: e["value"].isNotNull())
    df = df.withColumn("_leaves", pairs)
    return _raw(df.withColumn("_time", _first_time(F.col("_leaves"), s)), F.col("_time.value"), _others(F.col("_leaves"), F.col("_time.name")), source)


def kv_pairs(line: Column, s: ParserSettings) -> Column:
    """key and value structs of a line; delimiters inside double quotes don't split, the last of equal keys wins."""
    d, sep = re.escape(s.kv_delimiter), re.escape(s.kv_separator)
    parts = F.filter(F.split(line, d + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda p: F.contains(p, F.lit(s.kv_separator)))
    plain = F.filter(F.split(line, d), lambda p: F.contains(p, F.lit(s.kv_separator)))
    parts = F.when(F.contains(line, F.lit('"')), parts).otherwise(plain)
    clean = lambda c: F.regexp_replace(F.trim(c), r"^[\"'](.*)[\"']$", "$1")
    pair = lambda p: F.transform(F.array(F.split(p, sep, 2)), lambda x: F.struct(clean(x[0]).alias("name"), clean(x[1]).alias("value")))[0]
    # in one-element arrays, so that pairs are worked out once and not for each look at them
    once = lambda c, f: F.transform(F.array(c), f)[0]
    part = lambda *names: lambda p: F.struct(*[p[n].alias(n) for n in names])
    ends = lambda qs: F.filter(qs, lambda q, i: (i == F.size(qs) - 1) | (F.get(qs, i + 1)["name"] != q["name"]))
    placed = lambda ps: F.array_sort(F.transform(ps, lambda p, i: F.struct(p["name"].alias("name"), i.alias("place"), p["value"].alias("value"))))
    last = lambda ps: F.transform(F.array_sort(F.transform(once(placed(ps), ends), part("place", "name", "value"))), part("name", "value"))
    return once(F.transform(parts, pair), lambda ps: F.when(F.size(F.array_distinct(F.transform(ps, lambda q: q["name"]))) == F.size(ps), ps).otherwise(last(ps)))


def parse_kv(lines: DataFrame, settings: ParserSettings | None = None, source: str = "kv") -> DataFrame:
    """Raw observations of (line, value) rows."""
    s = settings or ParserSettings()
    df = lines.withColumn("_pairs", kv_pairs(F.col("value"), s))
    is_time = (lambda p: p["name"] == s.timestamp_column) if s.timestamp_column else (lambda p: F.lower(p["name"]).isin(*TIME_NAMES))
    time = F.try_element_at(F.filter("_pairs", is_time), F.lit(1))["value"]
    first = F.try_element_at(F.filter("_pairs", is_time), F.lit(1))["name"]
    # the time's name is bound before the pairs are gone through, or each pair would look for it again
    others = F.transform(F.array(first), lambda name: F.filter("_pairs", lambda p: ~p["name"].eqNullSafe(name)))[0]
    # and the time is a column of its own below the explode, or it would be worked out once for each pair
    return _raw(df.withColumn("_time", time), F.col("_time"), others, source)


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"


def clean_name(name: Column) -> Column:
    """Blanks and hyphens to _, other odd characters away, single _ inside."""
    n = F.regexp_replace(F.regexp_replace(F.trim(name), r"[\s-]+", "_"), r"[^\w]", "")
    return F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_|_$", "")


def _shape(word: Column) -> Column:
    """A word with every digit as 9 and without the brackets around it."""
    return F.translate(F.regexp_replace(word, r"^\[|\]$", ""), "0123456789", "9" * 10)


def leading_time(line: Column) -> Column:
    """struct<t, rest>: the time in front of a line, which is its first one to three words, and what follows it.

    Times are a date and a clock in one word or two, a month, day and clock, or a number before other words."""
    words = F.split(line, r"\s+", 4)
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    shape = [_shape(word(i)) for i in range(3)]
    clock = lambda x: x.startswith("99:99:99")
    month = word(0).isin(*MONTHS.split()) & shape[1].isin("9", "99") & clock(shape[2])
    n = (
        F.when(shape[0].startswith("9999-99-99T99:99:99"), 1).when((shape[0] == "9999-99-99") & clock(shape[1]), 2).when(month, 3)
        .when((F.size(words) > 1) & word(0).rlike(r"^\d+(\.\d+)?$"), 1).otherwise(0)
    )
    time = F.array_join(F.transform(F.slice(words, 1, n), lambda w: F.regexp_replace(w, r"^\[|\]$", "")), " ")
    rest = F.when(n == 0, line).otherwise(F.regexp_replace(line, F.concat(F.lit(r"^(?:\S+(?:\s+|$)){"), n.cast("string"), F.lit("}")), F.lit("")))
    return F.struct(F.nullif(time, F.lit("")).alias("t"), rest.alias("rest"))


#: What stands between a name and its value: a sign, or words that say so.
_BETWEEN = r"^(.*?)(?:\s*[=:]\s*|\s+is\s+|\s+(?:changed|set|updated)\s+to\s+)([^=:]*)$"


def stated(rest: Column) -> tuple[Column, Column, Column, Column]:
    """(does the line state a value, name, number, unit): the whole line must be a name in plain words, what says so, and
    a number with one unit at most."""
    name, tail = F.trim(F.regexp_extract(rest, _BETWEEN, 1)), F.trim(F.regexp_extract(rest, _BETWEEN, 2))
    number, unit = value_part(tail), unit_part(tail)
    ok = name.rlike(r"^[A-Za-z][\w -]*$") & number.rlike(NUMBER)
    return ok, clean_name(name), number, F.coalesce(unit, F.lit(""))


def pattern_groups(pattern: str) -> dict[str, int] | None:
    """Which group of a pattern is the variable, value, unit and timestamp: by these names (`name` also stands for
    variable), else the first three groups in order. None for patterns that don't compile or don't have two groups."""
    try:
        compiled = re.compile(pattern)
    except re.error:
        return None
    named = {("variable" if k == "name" else k): i for k, i in compiled.groupindex.items()}
    if {"variable", "value"} <= set(named):
        return {k: i for k, i in named.items() if k in ("variable", "value", "unit", "timestamp")}
    return dict(zip(("variable", "value", "unit"), range(1, compiled.groups + 1))) if compiled.groups >= 2 else None


def _without_names(pattern: str) -> str:
    """A pattern whose named groups are numbered ones: the names that Java allows are fewer."""
    names = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", plain)


def parse_text(lines: DataFrame, settings: ParserSettings | None = None, source: str = "text") -> DataFrame:
    """Raw observations of (line, value) rows: a time in front, then what the first of the settings' patterns that matches
    says, else a stated value; the line itself as log_line if there is neither."""
    s = settings or ParserSettings()
    v = F.trim("value")
    df = lines.filter(v != "").withColumn("_at", leading_time(v))
    rest = F.col("_at.rest")
    hit = None
    for p in s.text_patterns:
        if (found := pattern_groups(p)) is None:
            continue
        # as a pattern is matched from the text's start
        java, groups = "^(?:" + _without_names(p) + ")", found
        group = lambda k: F.nullif(F.trim(F.regexp_extract(rest, java, groups[k])), F.lit("")) if k in groups else F.lit(None).cast("string")
        got = F.struct(clean_name(group("variable")).alias("name"), group("value").alias("value"), F.coalesce(group("unit"), F.lit("")).alias("unit"), group("timestamp").alias("time"))
        matches = rest.rlike(java) & (got["name"] != "") & got["value"].isNotNull()
        hit = F.when(matches, got) if hit is None else hit.when(matches, got)
    ok, name, number, unit = stated(rest)
    no_time = F.lit(None).cast("string").alias("time")
    got = F.struct(name.alias("name"), number.alias("value"), unit.alias("unit"), no_time)
    hit = F.when(ok, got) if hit is None else hit.when(ok, got)
    none = F.struct(F.when(rest == "", "event").otherwise("log_line").alias("name"), F.when(rest == "", "ping").otherwise(rest).alias("value"), F.lit("").alias("unit"), no_time)
    df = df.withColumn("_hit", hit.otherwise(none))
    time = F.coalesce("_hit.time", "_at.t")
    return _raw(df, time, F.array(F.struct(F.col("_hit.name").alias("name"), F.col("_hit.value").alias("value"))), source, F.nullif(F.col("_hit.unit"), F.lit("")))


def delimiter_of(head: str) -> str | None:
    """The delimiter that the first two lines of a text have equally often, if there is one."""
    lines = head[:1024].splitlines()
    return next((d for d in ",\t;" if len(lines) >= 2 and lines[0].count(d) and lines[0].count(d) == lines[1].count(d)), None)


def sniff(head: str) -> str | None:
    """Format of a text by its first 1024 characters."""
    head = head[:1024]
    lines = head.splitlines()
    if head.lstrip()[:1] in ("{", "["):
        return "json"
    if lines and "=" in lines[0] and ("," in head or ";" in head):
        return "kv"
    return "csv" if delimiter_of(head) else None


def _text_lines(parse: Callable) -> Parse:
    def run(spark: SparkSession, path: str, settings: ParserSettings) -> DataFrame:
        return parse(_numbered(spark.read.option("encoding", settings.encoding).text(path)), settings, path)

    return run


for _name, _parse, _extensions in (("csv", read_csv, ("csv", "tsv")), ("json", read_json, ("json", "jsonl")), ("kv", _text_lines(parse_kv), ("kv", "kvlog")), ("text", _text_lines(parse_text), ("txt", "log"))):
    register_parser(_name, _parse, _extensions)
#: Other names of formats.
ALSO = {"tsv": "csv", "jsonl": "json", "log": "text", "txt": "text"}


def read(spark: SparkSession, source: str | list[str], format_name: str | None = None, settings: ParserSettings | None = None) -> DataFrame:
    """Raw observations of files: by name of format, by extension, by content, else free text. source may also be lines
    that are at hand (kv and text); settings without a delimiter of their own take the one that content shows."""
    s = settings or ParserSettings()
    kind = ALSO.get(format_name.lower(), format_name.lower()) if format_name else None
    if kind is not None and kind not in PARSERS:
        raise ValueError(f"unknown format {format_name}")
    if not isinstance(source, str):
        kind = kind or sniff("\n".join(source)) or "text"
        if kind not in ("kv", "text"):
            raise ValueError(f"lines are read as kv or text, not as {kind}")
        lines = spark.createDataFrame(list(enumerate(source)), "line bigint, value string")
        return (parse_kv if kind == "kv" else parse_text)(lines, s, "lines")
    kind = kind or EXTENSIONS.get(source.rpartition(".")[2].lower())
    if kind is None:
        head = "\n".join(r[0] for r in spark.read.text(source).limit(8).collect())
        kind = sniff(head) or "text"
        if kind == "csv" and s.delimiter == ",":
            s = replace(s, delimiter=delimiter_of(head) or ",")
    return PARSERS[kind](spark, source, s)
