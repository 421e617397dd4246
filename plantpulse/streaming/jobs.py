"""Streaming jobs: stateless scoring (T1), minute windows with a watermark
(T6), dedup of late / repeated readings (T7), fault sessions, and the runner
that drives a query to completion into the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def event_time(df: DataFrame, ts: str, name: str = "event_ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ)."""
    return df.withColumn(name, F.col(ts).cast("timestamp"))


def score_stream(model, stream: DataFrame) -> DataFrame:
    """A fitted ``PipelineModel`` applied to a stream (stateless)."""
    return model.transform(stream)


def dedup_readings(stream: DataFrame, ts: str, ids: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Drop repeated readings (same ids) arriving within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def minute_rollup(stream: DataFrame, keys: Sequence[str], ts: str, value: str, *,
                  window: str = "1 minute", slide: str | None = None,
                  delay: str | None = "2 minutes") -> DataFrame:
    """Tumbling (or sliding) event-time windows per device; append mode
    emits a window once the watermark passes its end. ``delay=None`` reuses
    a watermark defined upstream."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    src = stream.withWatermark(ts, delay) if delay else stream
    return (src.groupBy(*keys, w.alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
                       F.max(value).alias("max_value"))
                  .select(*keys, F.col("w.start").alias("window_start"),
                          F.col("w.end").alias("window_end"), "n", "mean_value", "max_value"))


def fault_sessions(stream: DataFrame, keys: Sequence[str], ts: str, *, gap: str = "10 minutes",
                   delay: str | None = "10 minutes") -> DataFrame:
    """Fault episodes -- session windows closing after ``gap`` without a
    fault reading."""
    src = stream.withWatermark(ts, delay) if delay else stream
    return (src
                  .groupBy(*keys, F.session_window(ts, gap).alias("s"))
                  .agg(F.count(F.lit(1)).alias("n_faults"))
                  .select(*keys, F.col("s.start").alias("session_start"),
                          F.col("s.end").alias("session_end"), "n_faults"))


def replay(df: DataFrame, ts: str, heartbeat: DataFrame, *, slices: int = 5, jitter_hours: int = 12,
           files: int = 1) -> str:
    """Write a table as ``slices`` slices of rising time for a file stream, rows
    out of order by up to ``jitter_hours`` across slices, and a last file with
    the ``heartbeat`` rows: later than all readings, they move the watermark
    past them, so that a bounded replay emits everything. Rows without a time
    are in the last slice; a watermark drops them, so give them one before.
    A slice is exactly ``files`` files (empty ones where rows are few): read that
    many per micro-batch, for a slice cut over micro-batches has rows behind the
    watermark of its own first files. Returns the folder."""
    spark = df.sparkSession
    out = scratch_path(spark, "replay")

    def append(rows: DataFrame, expected: int) -> None:
        rows.write.option("maxRecordsPerFile", 0).mode("append").parquet(out)
        written = len(spark.read.schema(df.schema).parquet(out).inputFiles())
        for _ in range(expected - written):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(out)

    us = F.unix_micros(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*df.columns), F.lit(jitter_hours * 3_600_000_000))
    shifted = df.withColumn("_pp_at", us)
    lo, hi, n = shifted.agg(F.min("_pp_at"), F.max("_pp_at"), F.count(F.lit(1))).first()
    if lo is None and n:
        append(df.repartition(files), files)
    if lo is not None:
        edges = [lo + (hi + 1 - lo) * i // slices for i in range(slices + 1)]
        for i, (a, b) in enumerate(zip(edges, edges[1:]), 1):
            here = (F.col("_pp_at") >= a) & (F.col("_pp_at") < b)
            if b == edges[-1]:
                here = here | F.col("_pp_at").isNull()
            append(shifted.filter(here).drop("_pp_at").repartition(files), i * files)
    heartbeat.select(*df.columns).coalesce(1).write.mode("append").parquet(out)
    return out


def run_to_table(df: DataFrame, name: str, *, output_mode: str = "append",
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Drive a streaming query over everything available (``availableNow``)
    into a Parquet table in the shared checkpoint folder, with its
    checkpoint next to it (restartable after a failure), and return the
    table as a batch DataFrame."""
    spark: SparkSession = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    w = (df.writeStream.format("parquet").outputMode(output_mode)
           .option("path", f"{out}/data").option("checkpointLocation", f"{out}/_checkpoint"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{out}/data")
