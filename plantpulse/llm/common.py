"""Helpers shared by the training-data operators: table access, Arrow batch
bounds, a scratch table in the shared folder, and small vectorised helpers
used inside tasks."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, materialize, release, scratch_path, ship_package  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bounds of one Arrow batch handed to a Python worker: a batch of very long
#: texts is cut by bytes, a batch of very short ones by rows.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the executors, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def llm_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` for the driver."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a document table: whole texts, NULL text as empty.
    Other columns, also ones named like an operator's own, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, mod ``folds``, equals ``fold`` (NULL id: crc of '')."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds) == F.lit(fold)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back (lineage cut)."""
    return materialize(df, name)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Return freed pages to the system: allocators keep those of dropped
    caches and batches."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give is not None:
        give(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType, tokenizes: bool = False) -> DataFrame:
    """``mapInArrow``. Python workers outlive their stages and wait next to the
    executor's heap; one that turns to work other than tokenizing lets go of its
    tokenizer's cache first, and each gives back a task's memory behind it."""
    name = f"{__package__}.tokens"

    def run(batches):
        if not tokenizes and name in sys.modules:
            sys.modules[name].forget()
        yield from fn(batches)
        trim()
    return df.mapInArrow(run, schema)


_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACE_RUN = re.compile(r"\s\s")


def space_chunks(text: str) -> list[str]:
    """Cut ``text`` at every single space between two non-space characters;
    every chunk but the first keeps that space in front. No pre-token of the
    byte-level pattern crosses such a cut and none looks across it, so each
    chunk is encoded on its own and repeated chunks are encoded once."""
    if not text:
        return []
    if _SPACE_RUN.search(text) or text[0].isspace() or text[-1].isspace():
        return _SAFE_SPACE.split(text)
    return text.split(" ")


def list_column(flat: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and per-row lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
