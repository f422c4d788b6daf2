"""Orders over whole tables without a window that has no partition.

Rows are dealt into ranges of their order; row numbers, neighbours and shifts are worked out inside each range and
completed from one summary row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rows of a block in which shifts are worked out.
BLOCK_ROWS = 1 << 16


def free_name(df: DataFrame, name: str) -> str:
    """name, with _ in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cuts(df: DataFrame, by: str, ranges: int | None = None) -> list[float]:
    """Values that cut df into about equal ranges of a numeric or time column: approximate quantiles, one scan, at most as
    many as there are shuffle partitions."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(as_number(df, by), [k / n for k in range(1, n)], 1000)).first()[0]
    return sorted(set(got or []))


def as_number(df: DataFrame, by: str) -> Column:
    kind = df.schema[by].dataType.simpleString()
    return (F.unix_micros(F.col(by).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(by)).cast("double")


def halved(value: Column, cuts: Column, most: int) -> Column:
    """How many of an array of cuts (in order, at most so many) are not above a value: by halving, as there may be as many
    cuts as tasks."""
    if not most:
        return F.lit(0)
    jumps = F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])
    # the array is bound, so that it is not worked out again for each look
    count = lambda at: F.aggregate(jumps, F.lit(0), lambda n, h: F.when((n + h <= F.size(at)) & (F.get(at, n + h - 1) <= value), n + h).otherwise(n))
    return F.transform(F.array(cuts), count)[0]


def range_of(value: Column, at: list[float]) -> Column:
    """Number of the range of a value: how many cuts are not above it. A few cuts are compared one by one in generated code."""
    if 0 < len(at) <= 32:
        return reduce(lambda a, b: a + b, [F.when(value >= x, 1).otherwise(0) for x in at])
    return halved(value, F.array(*[F.lit(x) for x in at]), len(at)) if at else F.lit(0)


def numbered(df: DataFrame, by: str, ties: list[str] | None = None, keys: list[str] | None = None, name: str = "_row", at: list[float] | None = None) -> DataFrame:
    """df with the 0-based row number in order of `by` and then of `ties`, for each value of the keys (none: of all rows).

    Numbers inside a range of `by` come from a window over the range, what is before it from a row a range; equal values
    of `by` are in one range. A null in `by` comes first."""
    keys, ties = keys or [], ties or []
    part, lead, range_, name_ = (free_name(df, x) for x in ("_range", "_lead", "_kr", "_k"))
    total = free_name(df, "n")
    df = df.withColumn(part, range_of(F.coalesce(as_number(df, by), F.lit(float("-inf"))), cuts(df, by) if at is None else at))
    counts = df.groupBy(*keys, part).agg(F.count("*").alias(total))
    before = W.Window.partitionBy(*keys).orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    named = [free_name(df, f"{name_}{i}") for i in range(len(keys))]
    counts = counts.select(*[F.col(k).alias(x) for k, x in zip(keys, named)], F.col(part).alias(range_), F.coalesce(F.sum(total).over(before), F.lit(0)).alias(lead))
    same = F.col(part) == F.col(range_)
    for k, x in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(x))
    own = F.row_number().over(W.Window.partitionBy(*keys, part).orderBy(by, *ties))
    out = df.withColumn(name, own).join(counts, same)
    return out.withColumn(name, (F.col(lead) + F.col(name) - 1).cast("bigint")).drop(part, lead, range_, *named)


def blocks(df: DataFrame, row: str = "_row", back: int = 0, ahead: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """df (with row numbers) dealt into blocks of rows: `_block`, and `_own`, false for the copies of the `back` rows before
    and `ahead` rows behind a block that it gets besides its own."""
    size = max(size, back, ahead, 1)
    at, home = F.col(row) % size, F.floor(F.col(row) / size)
    to = F.array(F.struct(home.alias("_block"), F.lit(True).alias("_own")))
    if back:
        to = F.when(at >= size - back, F.concat(to, F.array(F.struct((home + 1).alias("_block"), F.lit(False).alias("_own"))))).otherwise(to)
    if ahead:
        to = F.when((at < ahead) & (home > 0), F.concat(to, F.array(F.struct((home - 1).alias("_block"), F.lit(False).alias("_own"))))).otherwise(to)
    return df.select("*", F.inline(to))


def shifted(df: DataFrame, by: str, columns: dict[str, tuple[str, int]], ties: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with new columns name -> (column, lag): the column's value so many rows earlier in order of `by` (later, for a
    negative lag), null where there is no such row. Blocks of rows carry copies of the rows at their borders."""
    lags = [n for _, n in columns.values()]
    back, ahead = max([0, *lags]), max([0, *(-n for n in lags)])
    keys = keys or []
    # columns of the helpers' names wait under others
    aside = {c: free_name(df, f"_aside{i}") for i, c in enumerate(df.columns) if c.lower() in ("_block", "_own")}
    moved = lambda c: aside.get(c, c)
    names = df.columns
    df = df.withColumnsRenamed(aside)
    row = free_name(df, "_row")
    split = blocks(numbered(df, moved(by), [moved(t) for t in ties or []], [moved(k) for k in keys], row), row, back, ahead)
    w = W.Window.partitionBy(*[moved(k) for k in keys], "_block").orderBy(row)
    out = split.select("*", *[(F.lag(moved(c), n) if n >= 0 else F.lead(moved(c), -n)).over(w).alias(name) for name, (c, n) in columns.items()])
    out = out.filter("_own").drop("_own", "_block", row).withColumnsRenamed({v: k for k, v in aside.items()})
    return out.select(*names, *columns)


def nearest(df: DataFrame, by: str, before: dict[str, Column], after: dict[str, Column], keys: list[str] | None = None, at: list[float] | None = None) -> DataFrame:
    """df with new columns: for each of `before` the last non-null value of the expression at or before a row in order of
    `by`, for each of `after` the first at or behind it, among rows of the same keys. Rows of one key must differ in `by`.

    Inside a range a window does it; what comes from other ranges is looked up among one row a key and range."""
    keys = keys or []
    part, range_ = free_name(df, "_range"), free_name(df, "_kr")
    named = [free_name(df, f"_k{i}") for i in range(len(keys))]
    df = df.withColumn(part, range_of(F.coalesce(as_number(df, by), F.lit(float("-inf"))), cuts(df, by) if at is None else at))
    both = {**before, **after}
    df = df.withColumns({f"_x_{n}": e for n, e in both.items()})
    up, down = (W.Window.partitionBy(*keys, part).orderBy(o).rowsBetween(W.Window.unboundedPreceding, 0) for o in (F.asc(by), F.desc(by)))
    own = df.select("*", *[F.last(f"_x_{n}", True).over(up if n in before else down).alias(f"_y_{n}") for n in both])
    known = lambda n: F.when(F.col(f"_x_{n}").isNotNull(), F.struct(F.col(by), F.col(f"_x_{n}").alias("v")))
    ends = df.groupBy(*keys, part).agg(*[(F.max if n in before else F.min)(known(n)).alias(f"_e_{n}") for n in both])
    past, coming = (W.Window.partitionBy(*keys).orderBy(o).rowsBetween(W.Window.unboundedPreceding, -1) for o in (F.asc(part), F.desc(part)))
    ends = ends.select(*[F.col(k).alias(x) for k, x in zip(keys, named)], F.col(part).alias(range_), *[F.last(f"_e_{n}", True).over(past if n in before else coming)["v"].alias(f"_z_{n}") for n in both])
    same = F.col(part) == F.col(range_)
    for k, x in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(x))
    out = own.join(ends, same)
    out = out.withColumns({n: F.coalesce(f"_y_{n}", f"_z_{n}") for n in both})
    return out.drop(part, range_, *named, *[f"_{c}_{n}" for n in both for c in "xyz"])
