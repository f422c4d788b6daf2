"""Normalising text values: timestamps, units and types as column expressions."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Units by alias, with dimension, factor and offset to the dimension's base unit (value * factor + offset).
UNITS: dict[str, tuple[str, str, float, float]] = {}


def _units(dimension: str, canonical: str, factor: float, offset: float, aliases: str) -> None:
    for alias in [canonical, *aliases.split()]:
        UNITS[alias] = (canonical, dimension, factor, offset)


_units("temperature", "degree_Celsius", 1.0, 273.15, "C degC celsius Celsius °C")
_units("temperature", "degree_Fahrenheit", 5 / 9, 459.67 * 5 / 9, "F degF fahrenheit Fahrenheit °F")
_units("temperature", "kelvin", 1.0, 0.0, "K Kelvin")
_units("voltage", "volt", 1.0, 0.0, "V v volts")
_units("voltage", "millivolt", 1e-3, 0.0, "mV mv millivolts")
_units("voltage", "kilovolt", 1e3, 0.0, "kV kv kilovolts")
_units("current", "ampere", 1.0, 0.0, "A amp amps amperes")
_units("current", "milliampere", 1e-3, 0.0, "mA ma milliamperes")
_units("power", "watt", 1.0, 0.0, "W w watts")
_units("power", "kilowatt", 1e3, 0.0, "kW kw kilowatts")
_units("power", "megawatt", 1e6, 0.0, "MW")
_units("pressure", "pascal", 1.0, 0.0, "Pa")
_units("pressure", "kilopascal", 1e3, 0.0, "kPa")
_units("pressure", "megapascal", 1e6, 0.0, "MPa")
_units("pressure", "bar", 1e5, 0.0, "")
_units("pressure", "psi", 6894.757293168361, 0.0, "PSI")
_units("pressure", "atmosphere", 101325.0, 0.0, "atm")
_units("force", "newton", 1.0, 0.0, "N")
_units("energy", "joule", 1.0, 0.0, "J")
_units("frequency", "hertz", 1.0, 0.0, "Hz hz")
_units("frequency", "kilohertz", 1e3, 0.0, "kHz")
_units("frequency", "megahertz", 1e6, 0.0, "MHz")
_units("rotation", "revolutions_per_minute", 1.0, 0.0, "rpm RPM")
_units("length", "meter", 1.0, 0.0, "m meters")
_units("length", "centimeter", 1e-2, 0.0, "cm")
_units("length", "millimeter", 1e-3, 0.0, "mm")
_units("length", "kilometer", 1e3, 0.0, "km")
_units("length", "inch", 0.0254, 0.0, "in")
_units("length", "foot", 0.3048, 0.0, "ft")
_units("speed", "meter / second", 1.0, 0.0, "m/s")
_units("speed", "kilometer / hour", 1 / 3.6, 0.0, "km/h kph")
_units("speed", "mile / hour", 0.44704, 0.0, "mph")
_units("angle", "degree", 1.0, 0.0, "deg degrees")
_units("angle", "radian", 57.29577951308232, 0.0, "rad")
_units("time", "second", 1.0, 0.0, "s sec")
_units("time", "millisecond", 1e-3, 0.0, "ms")
_units("time", "minute", 60.0, 0.0, "min")
_units("time", "hour", 3600.0, 0.0, "h hr")
_units("mass", "kilogram", 1.0, 0.0, "kg")
_units("mass", "gram", 1e-3, 0.0, "g")
_units("mass", "milligram", 1e-6, 0.0, "mg")
_units("mass", "pound", 0.45359237, 0.0, "lb")
_units("share", "percent", 1.0, 0.0, "%")
#: The preferred unit of each dimension.
PREFERRED = {"temperature": "kelvin", "voltage": "volt", "current": "ampere", "power": "watt", "pressure": "pascal", "force": "newton", "energy": "joule", "frequency": "hertz", "length": "meter", "speed": "meter / second", "angle": "radian", "time": "second", "mass": "kilogram"}

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A unit begins with a letter or sign; digits, slashes and exponents may follow.
_UNIT = r"[\p{L}°%µ][\p{L}\d°%µ/^*._-]*"
#: A number as NUMBER has it, blanks, a unit.
_VALUE_UNIT = NUMBER.removeprefix("^").removesuffix("$").join(("^(", rf")\s*({_UNIT})$"))
BOOLS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}
FORMATS = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy", "MMM dd yyyy HH:mm:ss", "MMM dd yyyy"]


def value_part(text: Column) -> Column:
    """The number of a text with a unit behind it, else the trimmed text. A text that is a number as it stands has no unit."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, _VALUE_UNIT, 1), F.lit("")), t))


def unit_part(text: Column) -> Column:
    """The unit behind a number, else null."""
    t = F.trim(text)
    return F.when(~t.rlike(NUMBER), F.nullif(F.regexp_extract(t, _VALUE_UNIT, 4), F.lit("")))


def _lookup(unit: Column, pick: str) -> Column:
    """A field of a unit's row. The table is one literal once it is folded, not a branch for each unit."""
    rows = {alias: dict(zip(("name", "dimension", "factor", "offset", "preferred"), (*row, PREFERRED.get(row[1], row[0])), strict=True)) for alias, row in UNITS.items()}
    table = F.from_json(F.lit(json.dumps(rows)), "map<string,struct<name:string,dimension:string,factor:double,offset:double,preferred:string>>")
    return F.try_element_at(table, unit)[pick]


def canonical_unit(unit: Column) -> Column:
    """Canonical name of an alias; an unknown unit stays."""
    return F.coalesce(_lookup(F.trim(unit), "name"), unit)


def convert(value: Column, source: Column, target: Column) -> Column:
    """value in the target unit; as it is where either unit is unknown or of another dimension."""
    f1, o1, f2, o2 = _lookup(source, "factor"), _lookup(source, "offset"), _lookup(target, "factor"), _lookup(target, "offset")
    same = _lookup(source, "dimension") == _lookup(target, "dimension")
    return F.when(same & (source != target), (value * f1 + o1 - o2) / f2).otherwise(value)


def preferred_unit(unit: Column) -> Column:
    return F.coalesce(_lookup(F.trim(unit), "preferred"), unit)


def parses_as_time(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|^\d{1,2} [A-Za-z]{3} \d{4}|^[A-Za-z]{3} +\d{1,2}[ ,]") | t.rlike(r"^\d{9,13}(\.\d+)?$")


def is_timestamp(text: Column) -> Column:
    """Can the text be read as a time: a plain number, a date, or whatever else the lenient reader takes."""
    t = F.trim(text)
    fast = t.rlike(r"^\d+(\.\d+)?$") | parses_as_time(t)
    return F.coalesce((t != "") & (fast | lenient_timestamp(F.when(~fast & (t != ""), t)).isNotNull()), F.lit(False))


def infer_type(text: Column) -> Column:
    """Type of one text: BOOLEAN words (0 and 1 too) come first, then INTEGER, FLOAT, TIMESTAMP, else STRING. A TIMESTAMP
    has the shape of a date; is_timestamp() takes more."""
    t = F.trim(text)
    return (
        F.when(t == "", "STRING").when(F.lower(t).isin(*BOOLS), "BOOLEAN").when(t.rlike(r"^[+-]?\d+$"), "INTEGER")
        .when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "FLOAT").when(parses_as_time(t), "TIMESTAMP").otherwise("STRING")
    )


def infer_series(kind: Column, text: Column) -> dict[str, Column]:
    """Aggregates that tell the type of a whole variable from infer_type() of its values; see series_type()."""
    return {"n": F.count(text), "n_int": F.count_if(kind == "INTEGER"), "n_float": F.count_if(kind == "FLOAT"), "n_bool": F.count_if(kind == "BOOLEAN"), "n_time": F.count_if(kind == "TIMESTAMP"), "n_distinct": F.count_distinct(text)}


def series_type() -> Column:
    n = F.col("n")
    return (
        F.when(n == 0, "STRING").when(F.col("n_int") == n, "INTEGER").when(F.col("n_int") + F.col("n_float") == n, "FLOAT").when(F.col("n_bool") == n, "BOOLEAN")
        .when(F.col("n_time") == n, "TIMESTAMP").when((F.col("n_distinct") < 20) | (F.col("n_distinct") < 0.1 * n), "CATEGORICAL").otherwise("STRING")
    )


def timestamp(text: Column, pattern: str | None = None) -> Column:
    """Epoch seconds of a text; naive times are UTC; null where nothing reads it. Plain numbers are seconds as they stand."""
    t = F.trim(text)
    micros = lambda c: F.unix_micros(c) / F.lit(1e6)
    tries = [F.try_to_timestamp(t, F.lit(pattern))] if pattern else []
    tries += [F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))]
    shapes = {"yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}", "dd MMM": r"^\d{2} [A-Za-z]{3} ", "MMM dd": r"^[A-Za-z]{3} \d{2} "}
    for f in FORMATS:
        shape = next(v for k, v in shapes.items() if f.startswith(k))
        full = shape + (r".*\d:\d{2}:\d{2}$" if "HH" in f else r"[^:]*$")
        tries.append(F.when(t.rlike(full), F.try_to_timestamp(t, F.lit(f))))
    first = reduce(lambda a, b: F.coalesce(a, b), tries)
    return F.when(text.isNull() | (t == ""), F.lit(0.0)).when(t.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), t.try_cast("double")).otherwise(micros(first))


@F.pandas_udf(DoubleType())
def lenient_timestamp(text: pd.Series) -> pd.Series:
    """What timestamp() leaves, read by dateutil with 1970-01-01 for missing fields."""
    import datetime

    from dateutil import parser

    start = datetime.datetime(1970, 1, 1)

    def one(x: str | None) -> float | None:
        try:
            d = parser.parse(x, default=start)
        except (ValueError, OverflowError, TypeError):
            return None
        return (d if d.tzinfo else d.replace(tzinfo=datetime.UTC)).timestamp()

    return text.map(one)


def coerce(text: Column, kind: Column) -> dict[str, Column]:
    """The four typed columns of a value, of which the one of its type is set; what doesn't fit its type is null."""
    t = F.trim(text)
    t = F.when(F.lower(t).isin("", "nan", "null", "none", "na"), None).otherwise(t)
    number = F.when(t.rlike(NUMBER), t.try_cast("double"))
    words = F.try_element_at(F.create_map(*[F.lit(x) for k, v in BOOLS.items() for x in (k, v)]), F.lower(t))
    return {
        "value_float": F.when(kind == "FLOAT", number).when(kind == "TIMESTAMP", timestamp(t)),
        "value_int": F.when(kind == "INTEGER", F.coalesce(t.try_cast("bigint"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint"))),
        "value_str": F.when(kind.isin("STRING", "CATEGORICAL", "ENUM"), t),
        "value_bool": F.when(kind == "BOOLEAN", F.coalesce(words, F.when(t.isNotNull(), F.lit(True)))),
    }
