"""Streaming queries (T1-T7). Each drives a Structured Streaming query over
the driver table read as a file stream (``availableNow``), writes to the
shared checkpoint folder and returns the written table. The buffer queries
read a replay of out-of-order files, one per micro-batch; all must equal their
batch counterparts, so they share the batch oracles. Windows and sessions are
emitted when the watermark closes them; what is open when a bounded input ends
stays open (``minute_rollup`` and ``fault_sessions`` on a batch table emit
all)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rnd
from ..operators.alerts import alert_records
from ..operators.quality import QualityRules, in_range, not_null
from ..session import scratch_path
from ..sources.alert_store import AlertStore
from ..sources.readers import read_stream, read_table
from ..streaming import jobs as J
from ..streaming.stateful import buffer_features, cooldown
from .health import FEATURE_COLS, SERVING_SQL
from .registry import query
from .timeseries import _cooldown_sql
from .views import EVENT_READINGS_SQL, event_readings_from

_SERVING_ORACLE = SERVING_SQL.split("\nSELECT device_id, seq,")[0] + """
SELECT device_id, seq, n_window,
       round(mean_ripple, 6) AS mean_ripple, round(std_ripple, 6) AS std_ripple,
       round(mean_temp, 6) AS mean_temp, round(temp_rise, 6) AS temp_rise,
       round(mean_load, 6) AS mean_load, round(temp_range, 6) AS temp_range,
       CASE WHEN n_window < 20 THEN 'insufficient' ELSE 'ready' END AS window_status
FROM status
"""

# Stateless part of the inverter cleaning chain (the full-row dedup becomes a
# watermark-bounded dedup on the reading id in streaming).
_STREAM_RULES = QualityRules([
    not_null("temperature", "ripple", "load_factor"),
    in_range("load_factor", 0.0, 1.0, "load_range"),
    in_range("temperature", -50.0, 150.0, "temperature_range"),
    in_range("ripple", 0.0, 50.0, "ripple_range"),
])


def table_stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A driver table read as a file stream (the table's file inside the
    shared folder)."""
    schema = spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet").schema
    return read_stream(spark, sf.rstrip("/"), schema, "parquet", file_glob=f"{table}.parquet")


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table_stream(spark, sf, "events")


#: The device named in the closing heartbeat of a replay; a real one may have
#: it too, so the heartbeat is told by its sequence id.
HEARTBEAT = -1

#: Slices of a replay, one per micro-batch, and rows of one file of a slice.
SLICES, FILE_ROWS = 5, 500_000


def replayed_events(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The events as a stream of out-of-order slices, one per micro-batch, with
    a heartbeat five days later, and the heartbeat's event id, which no event
    has. Readings without a time come a day after all others, in order of
    their ids, as in the SQL twins (NULL times last): no reading is left out."""
    return replayed(read_table(spark, sf, "events"))


def replayed(e: DataFrame, beat_type: str = "beat") -> tuple[DataFrame, int]:
    spark = e.sparkSession
    end = F.coalesce(F.max("ts"), F.lit("1970-01-01").cast(e.schema["ts"].dataType))
    last = e.agg(end.alias("ts"), F.coalesce(F.min("event_id"), F.lit(0)).alias("least"),
                 F.count(F.lit(1)).alias("n")).first()  # one row
    files = max(1, -(-last["n"] // (SLICES * FILE_ROWS)))
    beat_id = min(last["least"], 0) - 1
    end = F.lit(last["ts"]).cast(e.schema["ts"].dataType)
    beat = spark.range(1).select(
        F.lit(beat_id).alias("event_id"), (end + F.expr("INTERVAL 5 DAYS")).alias("ts"), F.lit(HEARTBEAT).alias("user_id"),
        F.lit(beat_type).alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    beat = beat.select(*[F.col(f.name).cast(f.dataType) for f in e.schema.fields])
    timed = e.withColumn("ts", F.coalesce("ts", (end + F.expr("INTERVAL 1 DAY")).cast(e.schema["ts"].dataType)))
    folder = J.replay(timed, "ts", beat, slices=SLICES, files=files)
    return read_stream(spark, folder, e.schema, "parquet", max_files_per_trigger=files), beat_id


@query("stream_window_features", _SERVING_ORACLE)
def stream_window_features(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed bounded buffer (<= 19 readings per device in state) emitting
    the W2 trailing-window features for every reading."""
    events, beat = replayed_events(spark, sf)
    r = event_readings_from(events)
    clean, _ = _STREAM_RULES.apply(r.select("device_id", "ts", "seq", "temperature", "ripple", "load_factor"))
    clean = J.dedup_readings(J.event_time(clean, "ts"), "event_ts", ["seq"], "1 day")
    feats = buffer_features(clean, "device_id", "ts", "seq", ripple="ripple", temperature="temperature",
                            load="load_factor", size=20, watermarked="event_ts")
    out = J.run_to_table(feats, "window-features").filter(~F.col("seq").eqNullSafe(F.lit(beat)))
    return out.select("device_id", "seq", "n_window", *[rnd(c, 6).alias(c) for c in FEATURE_COLS],
                      "window_status")


@query("stream_alert_cooldown", _cooldown_sql("event_type = 'error'", "user_id", 21600))
def stream_alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """T4 gate -> T3 keyed cool-down state -> S6 alert rows, over a replay of
    out-of-order files; equals the batch cool-down."""
    e, beat = replayed(read_table(spark, sf, "events").filter(F.col("event_type") == "error"), "error")
    fired = cooldown(e, ["user_id"], "ts", "event_id", 21600, extra=["event_type"], watermark_delay="1 day")
    fired = fired.filter(F.col("event_id") != beat)
    alerts = alert_records(fired, "user_id", "ts", "event_type").withColumn("dt", F.to_date("alert_ts"))
    # The alert history table, partitioned by day, written exactly once
    out = J.run_to_table(alerts, "alerts", partition_by=["dt"])
    return out.drop("dt")


@query("stream_alert_table", """
WITH a AS (SELECT user_id AS device, event_type AS state, ts,
                  'device ' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS message
           FROM events WHERE event_type IN ('error', 'signup'))
SELECT device, state, min(ts) AS first_alert, max(ts) AS last_alert, count(*) AS n_alerts, max({'t': ts, 'm': message}).m AS message
FROM a GROUP BY device, state
""")
def stream_alert_table(spark: SparkSession, sf: str) -> DataFrame:
    """S6 keyed upsert: alerts of a replay of out-of-order files kept as one row
    per device and state, version by version."""
    events, beat = replayed_events(spark, sf)
    e = events.filter(F.col("event_type").isin("error", "signup") & (F.col("event_id") != beat))
    alerts = alert_records(e.withColumnsRenamed({"user_id": "device", "event_type": "state"}), "device", "ts", "state")
    path = scratch_path(spark, "alert-table")
    store = AlertStore(spark, path, ["device", "state"])
    store.run(alerts, f"{path}/_checkpoint")
    return store.read().select("device", "state", "first_alert", "last_alert", "n_alerts", "message")


@query("stream_hourly_rollup", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n,
                  round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value
           FROM events GROUP BY ALL)
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, n, mean_value, max_value
FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE
""")
def stream_hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """T7 dedup within the watermark (the stream is fed twice) -> T6 tumbling
    event-time windows; append mode emits the windows the watermark closed."""
    s = J.event_time(events_stream(spark, sf), "ts")
    doubled = s.unionByName(s)
    d = J.dedup_readings(doubled, "event_ts", ["event_id"], "2 minutes")
    agg = J.minute_rollup(d, ["event_type"], "event_ts", "value", window="1 hour", delay=None)
    out = J.run_to_table(agg, "hourly")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n",
                      rnd("mean_value", 6).alias("mean_value"), rnd("max_value", 6).alias("max_value"))


@query("stream_fault_sessions", """
WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
           FROM events WHERE event_type = 'error'),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
e AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_faults
      FROM s GROUP BY user_id, sid)
SELECT * FROM e WHERE session_end <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE
""")
def stream_fault_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Fault episodes per device as session windows (6 h gap)."""
    e = J.event_time(events_stream(spark, sf).filter(F.col("event_type") == "error"), "ts")
    sess = J.fault_sessions(e, ["user_id"], "event_ts", gap="6 hours", delay="10 minutes")
    out = J.run_to_table(sess, "sessions")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_faults")


@query("stream_rolling_std", f"""
WITH r AS ({EVENT_READINGS_SQL}),
c AS (SELECT * FROM r WHERE signal IS NOT NULL)
SELECT device_id, seq,
       round(CASE WHEN count(signal) OVER w >= 2 THEN stddev_pop(signal) OVER w ELSE 0.0 END, 6) AS std5_pop,
       round(avg(signal) OVER w, 6) AS mean5
FROM c WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def stream_rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    """T5 (+ W4): rolling population std of the last 5 readings kept in
    keyed state, 0 until two readings exist."""
    events, beat = replayed_events(spark, sf)
    r = event_readings_from(events).filter(F.col("signal").isNotNull())
    f = buffer_features(r, "device_id", "ts", "seq", ripple="signal", temperature="signal", load="signal", size=5)
    out = J.run_to_table(f, "rolling-std").filter(~F.col("seq").eqNullSafe(F.lit(beat)))
    std = F.when(F.col("n_window") >= 2, F.col("std_ripple")).otherwise(F.lit(0.0))
    return out.select("device_id", "seq", rnd(std, 6).alias("std5_pop"), rnd("mean_ripple", 6).alias("mean5"))


@query("stream_scored_shearer")
def stream_scored_shearer(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted shearer pipeline applied to a reading stream
    (stateless), with status (R15) and alert gate (T4); counted per outcome."""
    from ..functions import rules as R
    from ..operators.models import scored
    from .learning import shearer_model
    from .views import shearer_readings_from

    model = shearer_model(spark, sf)
    s = shearer_readings_from(table_stream(spark, sf, "lineitem"))
    sc = scored(model, s).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                 "prediction", F.col("probs")[1].alias("p_fault"))
    out = J.run_to_table(sc, "scored-shearer")
    return out.groupBy(R.binary_status(F.col("prediction").cast("int")).alias("status"),
                       (F.col("p_fault") > 0.8).alias("alert_gate")).agg(F.count(F.lit(1)).alias("n"))
