"""strandline ingest | discover | synthesize: the three stages from files to files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import knowledge, sinks, theory
from strandline.operators.registry import observations
from strandline.schema import IngestSettings
from strandline.sources.readers import read


def session() -> SparkSession:
    return SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def matrix_of(spark: SparkSession, path: str):
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    # rows of one time stay in the order of the file
    return df.withColumn("_place", F.monotonically_increasing_id()).orderBy(df.columns[0], "_place").drop("_place")


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args or args[0] not in ("ingest", "discover", "synthesize"):
        print("usage: strandline {ingest,discover,synthesize} ...", file=sys.stderr)
        return 2
    p = argparse.ArgumentParser(prog=f"strandline {args[0]}")
    p.add_argument("--output-dir", required=True)
    if args[0] == "ingest":
        p.add_argument("--input", required=True)
        p.add_argument("--config")
        p.add_argument("--format")
        p.add_argument("--batch-size", type=int, help="rows of a written file at most")
        o = p.parse_args(args[1:])
        settings = IngestSettings.from_toml(o.config) if o.config else IngestSettings()
        spark = session()
        obs, reg = observations(read(spark, o.input, o.format, settings.parser), settings)
        reg = reg.cache()
        matrix = sinks.state_matrix(obs, reg, settings.alignment_strategy, settings.missing_strategy, settings.default_missing_value)
        # each a folder of CSV files
        for name, table in (("canonical_triples.csv", sinks.observation_table(obs, reg)), ("aligned_state_matrix.csv", matrix), ("sparse_coordinates.csv", sinks.sparse_table(obs))):
            sinks.write(table, f"{o.output_dir}/{name}", most=o.batch_size or settings.batch_size)
        sinks.save_registry(reg, f"{o.output_dir}/registry.json")
    elif args[0] == "discover":
        p.add_argument("--input", required=True)
        o = p.parse_args(args[1:])
        df = matrix_of(session(), o.input)
        sinks.model_files(knowledge.discover(df, df.columns[0]), o.output_dir)
    else:
        p.add_argument("--input-dir", required=True)
        p.add_argument("--matrix")
        o = p.parse_args(args[1:])
        model = sinks.load_model(o.input_dir)
        df = matrix_of(session(), o.matrix) if o.matrix else None
        if df is not None and model.modes:
            spark = df.sparkSession
            names = [v for v in model.variables if v in df.columns]
            centres = spark.createDataFrame([(m["label"], *[float(m["centroid"].get(v) or 0.0) for v in names]) for m in model.modes], "mode string, " + ", ".join(f"`{v}` double" for v in names))
            model.labels = theory.nearest_centroid(df, centres, names, "mode").select(df.columns[0], "mode")
        sinks.theory_files(theory.synthesize(model, df, df.columns[0] if df is not None else "ts"), o.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
