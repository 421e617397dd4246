"""Scans: CSV with a fixed schema (S1), driver Parquet tables (S3), sensor
streams (S4) and JSON readings (S5)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import ALIASES

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *,
             mode: str = "FAILFAST") -> DataFrame:
    """Header CSV read with an explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("mode", mode)
            .csv(path))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3: one driver Parquet table. Projection / filters applied later are
    pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Normalise NaN to NULL in floating columns: Spark orders NaN above every
    number (``NaN > 10`` is true) whereas the reference's comparisons with NaN
    are all false, so NaN must never reach a predicate."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or floating) if c in floating]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def apply_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Rename CamelCase training columns to the snake_case contract."""
    present = {k: v for k, v in aliases.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, file_glob: str | None = None) -> DataFrame:
    """A sensor reading stream from a folder of files (``file_glob``
    picks the table's files inside a shared folder). A Kafka source gives the
    same downstream plan after ``from_json``."""
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)


def parse_json(col: Column | str, schema: T.StructType) -> Column:
    """JSON request body -> struct of named fields (NULL for bad input)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def to_json_response(**fields: Column) -> Column:
    """Result record -> JSON text (``{status, probability, message}``)."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
