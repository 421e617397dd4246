"""A replayed slice is one micro-batch, however many files and tasks wrote the table."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from plantpulse.plans import streams

Q = E.queries()


@pytest.mark.parametrize("file_rows", [500_000, 7])
def test_a_table_of_many_parts_loses_no_reading(spark, tmp_path, monkeypatch, file_rows):
    """Every part of the table covers all its time, so a part read alone moves
    the watermark past the rows of the next ones. A slice has few rows: with
    seven a file, some files are empty."""
    monkeypatch.setattr(streams, "FILE_ROWS", file_rows)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 50) * 43_200).cast("timestamp_ntz")
    e = spark.range(400).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") / 50).cast("long").alias("user_id"),
        F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.repartition(8, "user_id").write.parquet(f"{tmp_path}/events.parquet")
    stored = Q["stream_alert_table"](spark, str(tmp_path)).collect()
    assert sorted((r.device, r.n_alerts) for r in stored) == [(d, 50) for d in range(8)]
    fired = Q["stream_alert_cooldown"](spark, str(tmp_path))
    assert fired.count() == Q["alert_cooldown_errors"](spark, str(tmp_path)).count() == 400
    assert Q["stream_rolling_std"](spark, str(tmp_path)).count() == (400 - len(range(0, 400, 17)))
