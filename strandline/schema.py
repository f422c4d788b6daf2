"""Schemas and settings of observations, findings and models."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

OBSERVATIONS = "timestamp double, variable_id int, value_float double, value_int bigint, value_str string, value_bool boolean, quality tinyint, original_timestamp string, source string"
RAW = "seq struct<source:string,start:bigint,line:bigint,place:int>, timestamp_raw string, variable_name string, value_raw string, source string, unit_raw string"
#: The same with the order of the rows.
SEQUENCED = f"seq bigint, {OBSERVATIONS}"
QUALITY = ["MEASURED", "ESTIMATED", "INTERPOLATED", "DERIVED", "UNKNOWN"]
TYPES = ["INTEGER", "FLOAT", "BOOLEAN", "STRING", "CATEGORICAL", "ENUM", "TIMESTAMP"]
ALIGNMENTS = ["exact", "nearest", "forward_fill", "interpolate"]
FILLS = ["leave", "default", "forward_fill", "interpolate"]
#: Names that mark a timestamp column, whatever their case.
TIME_NAMES = ["timestamp", "time", "datetime", "date", "t", "ts"]


@dataclass
class ParserSettings:
    timestamp_column: str | None = None
    timestamp_format: str | None = None
    delimiter: str = ","
    kv_separator: str = "="
    kv_delimiter: str = ","
    text_patterns: list[str] = field(default_factory=list)
    encoding: str = "utf-8"


@dataclass
class IngestSettings:
    timestamp_column: str | None = None
    timestamp_format: str | None = None
    default_quality: str = "MEASURED"
    #: Rows that a store holds before they become a table, and rows of a file that the command line writes at most.
    batch_size: int = 10_000
    missing_strategy: str = "leave"
    alignment_strategy: str = "forward_fill"
    default_missing_value: float | None = None
    type_overrides: dict[str, str] = field(default_factory=dict)
    unit_overrides: dict[str, str] = field(default_factory=dict)
    parser: ParserSettings = field(default_factory=ParserSettings)
    #: Relabel overridden units without converting values.
    relabel_only: bool = False

    @classmethod
    def from_dict(cls, d: dict) -> IngestSettings:
        """Sections general, parser, type_overrides and unit_overrides; unknown keys are an error."""
        known = {f.name for f in fields(cls)} - {"parser", "type_overrides", "unit_overrides"}
        general = d.get("general", {})
        if odd := set(general) - known:
            raise ValueError(f"unknown settings: {sorted(odd)}")
        out = cls(**general, parser=ParserSettings(**d.get("parser", {})), type_overrides={k: v.upper() for k, v in d.get("type_overrides", {}).items()}, unit_overrides=dict(d.get("unit_overrides", {})))
        if out.alignment_strategy not in ALIGNMENTS or out.missing_strategy not in FILLS or out.default_quality not in QUALITY or set(out.type_overrides.values()) - set(TYPES):
            raise ValueError("unknown strategy, quality or type")
        if not isinstance(out.batch_size, int) or out.batch_size < 1:
            raise ValueError("batch_size must be a positive whole number")
        return out

    @classmethod
    def from_toml(cls, path: str) -> IngestSettings:
        return cls.from_dict(tomllib.loads(Path(path).read_text()))


@dataclass
class ExportSettings:
    missing_strategy: str = "leave"
    alignment_strategy: str = "forward_fill"
    default_missing_value: float | None = None
    variables: list[int] | None = None
    time_range: tuple[float, float] | None = None
    format: str = "csv"

    @classmethod
    def of(cls, s: IngestSettings) -> ExportSettings:
        """An ingest's own strategies."""
        return cls(s.missing_strategy, s.alignment_strategy, s.default_missing_value)


@dataclass
class DiscoverySettings:
    pearson_min: float = 0.5
    spearman_min: float = 0.5
    mi_min: float = 0.2
    p_max: float = 0.05
    min_coverage: float = 0.5
    max_lag: int = 50
    xcorr_min: float = 0.4
    jump_z: float = 2.5
    min_jumps: int = 3
    granger_lag: int = 10
    granger_p: float = 0.05
    granger_pairs: int = 100
    tree_depth: int = 4
    leaf_rows: int = 10
    rule_support: float = 0.05
    rule_precision: float = 0.6
    rule_conditions: int = 3
    cluster_size: int = 5
    max_k: int = 8
    mode_prevalence: float = 0.02
    #: Starts of k-means for each k.
    mode_starts: int = 10
    mode_features: int = 4
    min_confidence: float = 0.3
    seed: int = 42


@dataclass
class TheorySettings:
    min_confidence: float = 0.4
    p_max: float = 0.05
    max_degree: int = 2
    min_r2: float = 0.30
    cut: float = 0.75
    max_subsystems: int = 5
    #: Nodes of a feedback loop at most; None: any number.
    max_loop: int | None = None
