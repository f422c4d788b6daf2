"""A registry and a store that grow while a program runs, and the pipeline object over them.

They hold what a program adds row by row; what is in files goes through sources.readers and registry.observations."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import knowledge, sinks
from strandline.operators.registry import observations
from strandline.schema import QUALITY, SEQUENCED, TYPES, DiscoverySettings, ExportSettings, IngestSettings
from strandline.sources import readers


@dataclass
class Variable:
    id: int
    name: str
    dtype: str = "FLOAT"
    unit: str | None = None
    source: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


class VariableRegistry:
    """Variables by id (from 1, in order of registration) and by name; safe to use from several threads."""

    def __init__(self, variables: Iterable[Variable] = ()):
        self._lock = threading.RLock()
        self._by_name: dict[str, Variable] = {v.name: v for v in variables}
        self._by_id = {v.id: v for v in self._by_name.values()}

    def register(self, name: str, dtype: str, unit: str | None = None, source: str | None = None, metadata: dict | None = None) -> Variable:
        """A new variable; a name that is there already is an error."""
        if dtype not in TYPES:
            raise ValueError(f"unknown type {dtype}")
        with self._lock:
            if name in self._by_name:
                raise ValueError(f"variable {name} is registered already")
            v = Variable(max(self._by_id, default=0) + 1, name, dtype, unit, source, dict(metadata or {}))
            self._by_name[name] = self._by_id[v.id] = v
            return v

    def get_or_create(self, name: str, dtype: str | None = None, unit: str | None = None, source: str | None = None) -> Variable:
        with self._lock:
            return self._by_name.get(name) or self.register(name, dtype or "FLOAT", unit, source)

    def get_by_id(self, variable_id: int) -> Variable | None:
        return self._by_id.get(variable_id)

    def get_by_name(self, name: str) -> Variable | None:
        return self._by_name.get(name)

    def __len__(self) -> int:
        return len(self._by_name)

    def __contains__(self, item: object) -> bool:
        return item in self._by_id if isinstance(item, int) else item in self._by_name

    def __iter__(self) -> Iterator[Variable]:
        return iter([self._by_id[i] for i in sorted(self._by_id)])

    def to_dict(self) -> list[dict]:
        return [asdict(v) for v in self]

    @classmethod
    def from_dict(cls, rows: Iterable[dict]) -> VariableRegistry:
        return cls(Variable(**r) for r in rows)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v.id, v.name, v.dtype, v.unit, v.source) for v in self], "id int, name string, dtype string, unit string, source string")

    @classmethod
    def from_df(cls, registry: DataFrame) -> VariableRegistry:
        """From a registry frame: a row a variable."""
        return cls(Variable(r.id, r.name, r.dtype, r.unit, r.source) for r in registry.collect())


def typed(value: Any) -> dict[str, Any]:
    """The typed columns of a value: booleans before integers, then floats; everything else is text."""
    out: dict[str, Any] = dict.fromkeys(("value_float", "value_int", "value_str", "value_bool"))
    if value is not None:
        kind = "value_bool" if isinstance(value, bool) else "value_int" if isinstance(value, int) else "value_float" if isinstance(value, float) else "value_str"
        out[kind] = str(value) if kind == "value_str" else value
    return out


class ObservationStore:
    """Observations added one by one; every batch_size of them become a table of their own."""

    def __init__(self, spark: SparkSession, batch_size: int = IngestSettings.batch_size):
        self.spark, self.batch_size = spark, batch_size
        self.clear()

    def append(self, timestamp: float, variable_id: int, value: Any, quality: str = "MEASURED", original_timestamp: str | None = None, source: str | None = None) -> None:
        t = typed(value)
        self._rows.append((self._n, float(timestamp), variable_id, t["value_float"], t["value_int"], t["value_str"], t["value_bool"], QUALITY.index(quality), original_timestamp, source))
        self._n += 1
        if len(self._rows) >= self.batch_size:
            self.flush()

    def append_batch(self, rows: Iterable[tuple]) -> None:
        for r in rows:
            self.append(*r)

    def flush(self) -> None:
        if self._rows:
            self._tables.append(self.spark.createDataFrame(self._rows, SEQUENCED))
            self._rows = []

    def to_df(self) -> DataFrame:
        """All observations in order of `seq`; an empty store keeps the schema."""
        self.flush()
        return reduce(DataFrame.union, self._tables) if self._tables else self.spark.createDataFrame([], SEQUENCED)

    def __len__(self) -> int:
        return self._n if not self._loaded else self.to_df().count()

    def iter_batches(self) -> Iterator[pa.Table]:
        self.flush()
        return (t.drop("seq").toArrow() for t in self._tables)

    def get_value_at(self, index: int) -> Any:
        """The value of the row with that `seq`; an index that isn't there is an error."""
        r = self.to_df().filter(F.col("seq") == index).first()
        if r is None:
            raise IndexError(index)
        return next((r[c] for c in ("value_bool", "value_int", "value_float", "value_str") if r[c] is not None), None)

    def clear(self) -> None:
        self._rows: list[tuple] = []
        self._tables: list[DataFrame] = []
        self._n, self._loaded = 0, False

    def save_parquet(self, path: str) -> None:
        self.to_df().write.mode("overwrite").parquet(path)

    @classmethod
    def load_parquet(cls, spark: SparkSession, path: str, batch_size: int = 10_000) -> ObservationStore:
        out = cls(spark, batch_size)
        df = sinks.load_observations(spark, path)
        out._tables, out._loaded = [df.select(*spark.createDataFrame([], SEQUENCED).columns)], True
        out._n = (df.agg(F.max("seq")).first()[0] if df.schema["seq"].dataType.simpleString() == "bigint" else None) or 0
        out._n += 1
        return out


class Pipeline:
    """Sources one after another into one registry and one table of observations, and out again."""

    def __init__(self, spark: SparkSession, settings: IngestSettings | None = None):
        self.spark, self.settings = spark, settings or IngestSettings()
        self._raw: list[DataFrame] = []
        self._typed: tuple[DataFrame, DataFrame] | None = None
        self._kept: list[DataFrame] = []

    def ingest(self, source: str | list[str], format_name: str | None = None) -> DataFrame:
        """Adds a source's raw rows and returns them; rows of later sources come later."""
        parser = self.settings.parser
        if parser.timestamp_column is None and self.settings.timestamp_column:
            parser = replace(parser, timestamp_column=self.settings.timestamp_column)
        raw = readers.read(self.spark, source, format_name, parser)
        self._raw.append(raw.withColumn("seq", F.struct(F.lit(len(self._raw)).alias("batch"), F.col("seq").alias("at"))))
        self.release()
        return raw

    def observations(self) -> tuple[DataFrame, DataFrame]:
        """(observations, registry) of all sources. Raw rows are kept by the executors (in memory, else on disk) until they
        are typed; typed rows are a written table, which exports read until the next source or release()."""
        if not self._raw:
            raise ValueError("nothing has been ingested")
        if self._typed is None:
            raw = reduce(DataFrame.unionByName, self._raw).persist()
            obs, reg = observations(raw, self.settings)
            raw.unpersist()
            self._typed = obs, reg.persist()
            self._kept = [reg]
        return self._typed

    def release(self) -> None:
        """Frees what observations() keeps."""
        for x in self._kept:
            x.unpersist()
        self._typed, self._kept = None, []

    def discover(self, settings: DiscoverySettings | None = None) -> knowledge.SystemModel:
        """A system model of all sources' state matrix, aligned as the settings say, with what the registry tells."""
        obs, reg = self.observations()
        matrix = sinks.state_matrix(obs, reg, self.settings.alignment_strategy, self.settings.missing_strategy, self.settings.default_missing_value)
        return knowledge.discover(matrix, "timestamp", settings, reg)

    def export(self, mode: str, path: str, export: ExportSettings | None = None) -> None:
        sinks.export(*self.observations(), mode, path, export or ExportSettings.of(self.settings))


#: What an exporter gives: the table to write, of observations, registry and settings.
Exporter = Callable[[DataFrame, DataFrame, ExportSettings], DataFrame]


def register_exporter(mode: str, make: Exporter) -> None:
    """Adds a mode of export() beside observation, state_matrix and sparse."""
    sinks.EXPORTERS[mode] = make


