"""Edge cases every fixture set must hold (FIXTURES.md section 3)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions import features as X
from plantpulse.functions import rules as R
from plantpulse.operators import profile as A
from plantpulse.operators import windows as W
from plantpulse.operators.quality import DEDUP, QualityRules, in_range, not_null
from plantpulse.sources.readers import nan_to_null, read_stream
from plantpulse.sources.sinks import append_alerts, append_history
from plantpulse.streaming import jobs as J
from plantpulse.streaming.stateful import cooldown


def test_nan_and_bounds_in_cleaning(spark):
    rows = [(0.0,), (10.0,), (-0.001,), (10.001,), (float("nan"),), (None,), (5.0,), (5.0,)]
    df = nan_to_null(spark.createDataFrame(rows, "v double"))
    rules = QualityRules([not_null("v"), in_range("v", 0.0, 10.0, "v_range"), DEDUP])
    rep = {r.step: r.n_rows for r in rules.report(df).collect()}
    assert rep == {"null": 2, "v_range": 2, "duplicate": 1, "kept": 3}


def test_nan_never_passes_a_predicate(spark):
    df = spark.createDataFrame([(float("nan"),)], "v double")
    raw = df.select((F.col("v") > 10).alias("gt")).first().gt
    clean = nan_to_null(df).select((F.col("v") > 10).alias("gt")).first().gt
    assert raw is True and clean is None


def test_the_look_ahead_waits_for_the_next_reading(spark, tmp_path):
    """Neither SQL nor code ends the search for the target at some time."""
    from plantpulse.plans import QUERIES

    rows = [(1, 0, 1, 5.0), (2, 3600, 1, 6.0), (3, 3601, 1, 7.0), (4, 400_000, 1, 8.0), (5, 10, 2, 9.0)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select(
        "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id",
        F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq: r.target_signal for r in QUERIES["look_ahead_target"](spark, str(tmp_path)).collect()}
    assert got == {1: 7.0, 2: 8.0, 3: 8.0, 4: None, 5: None}


def test_zero_denominators_do_not_raise(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "flow double, head double, power double")
    r = df.select(X.efficiency_index("flow", "head", "power").alias("e"),
                  X.specific_power("power", "flow").alias("s"),
                  X.flow_ratio("flow", "power").alias("q")).first()
    assert r.e == 0.0 and r.s == 0.0 and r.q == 0.0


@pytest.mark.parametrize("n,expected", [(4, 0), (20, 0), (21, 1)])
def test_w1_device_sizes(spark, n, expected):
    df = (spark.range(n).select(F.lit(1).alias("dev"), F.col("id").alias("seq"),
                                F.timestamp_seconds(F.col("id")).alias("ts"),
                                F.col("id").cast("double").alias("t")))
    out = W.lagged_window_features(df, ["dev"], ["ts", "seq"], ripple="t", temperature="t", load="t")
    assert out.count() == expected
    served = W.lagged_window_features(df, ["dev"], ["ts", "seq"], ripple="t", temperature="t", load="t",
                                      include_current=True)
    ready = served.filter(F.col("window_status") == "ready").count()
    assert ready == max(0, n - 19)


def test_equal_timestamps_order_by_id(spark):
    rows = [(1, i, 100) for i in range(5)]
    df = spark.createDataFrame(rows, "dev int, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = W.first_difference(df.withColumn("v", F.col("id").cast("double")), ["dev"], ["ts", "id"], "v", "d",
                             per_second=True)
    got = {r.id: r.d for r in out.collect()}
    assert got[0] is None and all(got[i] is None for i in range(1, 5))  # no time passed


def test_constant_column_histogram_and_zscore(spark):
    df = spark.createDataFrame([(7.0,)] * 10, "v double")
    h = A.histogram(df, "v", bins=30).collect()
    assert len(h) == 1 and h[0].bin == 15 and h[0].n == 10
    z = A.standard_scale(df, ["v"]).select("v_z").distinct().collect()
    assert [r.v_z for r in z] == [0.0]


def test_message_builder(spark):
    df = spark.createDataFrame([(12.5, 95.0, 180.0, 40.0)], "v double, t double, c double, o double")
    msg = df.select(X.risk_factor_message(F.lit("shearer 7: fault"),
                                          R.shearer_risk_factors("v", "t", "c", "o")).alias("m")).first().m
    assert msg.splitlines()[0] == "shearer 7: fault" and len(msg.splitlines()) == 4
    assert "vibration too high: 12.50 (threshold 8, high)" in msg


def test_history_and_alert_tables_partition_by_day(spark):
    out = tempfile.mkdtemp(prefix="pp-hist-")
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 11:00:00")], "d int, ts string") \
              .withColumn("ts", F.to_timestamp("ts"))
    append_history(df, f"{out}/h")
    append_alerts(df.withColumnRenamed("ts", "alert_ts"), f"{out}/a")
    assert sorted(p for p in os.listdir(f"{out}/h") if p.startswith("dt=")) == ["dt=2024-01-01", "dt=2024-01-02"]
    assert spark.read.parquet(f"{out}/a").count() == 2


def test_stream_late_and_duplicate_rows(spark):
    """Second micro-batch holds a duplicate and a row older than those seen: the
    dedup drops the duplicate, the cool-down takes the other in its place."""
    root = tempfile.mkdtemp(prefix="pp-stream-")
    schema = T.StructType([T.StructField("dev", T.IntegerType()), T.StructField("id", T.LongType()),
                           T.StructField("ts", T.TimestampType())])
    mk = lambda rows: spark.createDataFrame(rows, "dev int, id long, s long").select(
        "dev", "id", F.timestamp_seconds("s").alias("ts"))
    s = read_stream(spark, f"{root}/in/*", schema, "parquet", max_files_per_trigger=1)
    d = J.dedup_readings(s.withColumn("at", F.col("ts")), "at", ["id"], "1 hour")
    fired = cooldown(d, ["dev"], "ts", "id", 600, watermark_delay=None)
    # restarted for each file; the last one is a heartbeat
    for i, rows in enumerate([[(1, 1, 1000), (1, 2, 1700)], [(1, 2, 1700), (1, 3, 1200), (1, 4, 2400)], [(2, 5, 100_000)]]):
        mk(rows).coalesce(1).write.parquet(f"{root}/in/b{i}")
        q = (fired.writeStream.format("parquet").option("path", f"{root}/out")
                  .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [1, 2, 4]
