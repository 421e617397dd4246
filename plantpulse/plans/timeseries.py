"""Time-series queries on the ``events`` reading stream: rolling windows
(W3-W9), fills (P13-P17), joins (J2-J5), alerting (T3, T4, S6), period
profiles (A9, A15-A18), ordering (O3, O5) and unions (U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rnd
from ..operators import profile as A
from ..operators import windows as W
from ..operators.alerts import alert_records, cooldown_fired
from ..operators.joins import align_signals, asof_backward, asof_forward_value, join_small, lookup, not_yet_alerted
from ..operators.quality import fill_mean, sigma_band
from ..sources.readers import read_table
from .registry import query
from .views import EVENT_READINGS_SQL, event_readings

KEYS, ORDER = ["device_id"], ["ts", "seq"]


def _readings(spark, sf) -> DataFrame:
    return event_readings(spark, sf).select("device_id", "ts", "seq", "state", "signal")


# ------------------------------------------------------------------ rolling windows

@query("rolling_signal_features", f"""
WITH r AS ({EVENT_READINGS_SQL}),
w AS (SELECT device_id, seq, signal,
             stddev_samp(signal) OVER w5 AS std5_samp,
             CASE WHEN count(signal) OVER w5 >= 2 THEN stddev_pop(signal) OVER w5 ELSE 0.0 END AS std5_pop,
             CASE WHEN count(signal) OVER w10 = 10 THEN avg(signal) OVER w10 END AS mean10,
             signal - lag(signal) OVER w AS diff1,
             (signal - lag(signal) OVER w)
               / nullif(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 0) AS rate_per_s
      FROM r
      WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq),
             w5 AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
             w10 AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT device_id, seq, round(std5_samp, 6) AS std5_samp, round(std5_pop, 6) AS std5_pop,
       round(mean10, 6) AS mean10, round(diff1, 6) AS diff1, round(rate_per_s, 6) AS rate_per_s
FROM w
""")
def rolling_signal_features(spark: SparkSession, sf: str) -> DataFrame:
    """W3 rolling sample std (5), W4 population std with a minimum count,
    W5 rolling mean (10, NULL until full), W6 first difference, W7 rate per
    second."""
    df = _readings(spark, sf)

    def cols(w):
        w5, w10 = w.rowsBetween(-4, 0), w.rowsBetween(-9, 0)
        us = W.epoch_micros("ts")
        d = F.col("signal") - F.lag("signal", 1).over(w)
        dt = (us - F.lag(us, 1).over(w)) / 1e6
        return {
            "std5_samp": F.stddev_samp("signal").over(w5),
            "std5_pop": F.when(F.count("signal").over(w5) >= 2, F.stddev_pop("signal").over(w5))
                         .otherwise(F.lit(0.0)),
            "mean10": F.when(F.count("signal").over(w10) == 10, F.avg("signal").over(w10)),
            "diff1": d,
            "rate_per_s": F.try_divide(d, F.when(dt != 0, dt)),
        }
    # one halo pass serves all five features (the widest frame needs 9 rows)
    df = W.rows_window(df, KEYS, ORDER, cols, preceding=9)
    return df.select("device_id", "seq", *[rnd(c, 6).alias(c) for c in
                                           ["std5_samp", "std5_pop", "mean10", "diff1", "rate_per_s"]])


@query("signal_fills", f"""
WITH r AS ({EVENT_READINGS_SQL}),
f AS (SELECT device_id, seq, ts, signal,
             last_value(signal IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
             last_value(CASE WHEN signal IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_ts,
             first_value(signal IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, seq
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_v,
             first_value(CASE WHEN signal IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, seq
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ts,
             avg(signal) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth
      FROM r)
SELECT device_id, seq, round(ffill, 6) AS ffill,
       round(CASE WHEN signal IS NOT NULL THEN signal
                  ELSE ffill + (next_v - ffill) * (date_diff('microsecond', prev_ts, ts)
                        / nullif(date_diff('microsecond', prev_ts, next_ts), 0)) END, 6) AS interpolated,
       round(smooth, 6) AS smooth
FROM f
""")
def signal_fills(spark: SparkSession, sf: str) -> DataFrame:
    """P15 forward fill, P16 time-linear interpolation, P17 centred moving
    average (noise filter) -- all chunk-carried per device."""
    df = _readings(spark, sf).withColumn("ffill", F.col("signal"))
    df = W.forward_fill(df, KEYS, ORDER, ["ffill"])
    df = W.interpolate(df, KEYS, ORDER, "signal", "interpolated", ts_col="ts")
    df = W.centred_mean(df, KEYS, ORDER, "signal", "smooth", half_width=2)
    return df.select("device_id", "seq", *[rnd(c, 6).alias(c) for c in ["ffill", "interpolated", "smooth"]])


@query("signal_fills_bounded", f"""
WITH r AS ({EVENT_READINGS_SQL}),
f AS (SELECT device_id, seq, ts, signal,
             last_value(signal IGNORE NULLS) OVER before AS prev_v,
             last_value(CASE WHEN signal IS NOT NULL THEN ts END IGNORE NULLS) OVER before AS prev_ts,
             first_value(signal IGNORE NULLS) OVER after AS next_v,
             first_value(CASE WHEN signal IS NOT NULL THEN ts END IGNORE NULLS) OVER after AS next_ts,
             median(signal) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS middle
      FROM r
      WINDOW before AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             after AS (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT device_id, seq,
       round(CASE WHEN signal IS NOT NULL THEN signal
                  WHEN next_ts - prev_ts <= INTERVAL 24 HOUR
                  THEN prev_v + (next_v - prev_v) * (date_diff('microsecond', prev_ts, ts)
                        / nullif(date_diff('microsecond', prev_ts, next_ts), 0)) END, 6) AS interpolated,
       round(middle, 6) AS middle
FROM f
""")
def signal_fills_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """P16 with ``max_gap`` (known values at most a day apart), P17 by medians."""
    df = W.interpolate(_readings(spark, sf), KEYS, ORDER, "signal", "interpolated", ts_col="ts", max_gap=86_400.0)
    df = W.centred_mean(df, KEYS, ORDER, "signal", "middle", half_width=2, median=True)
    return df.select("device_id", "seq", *[rnd(c, 6).alias(c) for c in ["interpolated", "middle"]])


@query("every_fifth_reading", f"""
WITH r AS ({EVENT_READINGS_SQL})
SELECT device_id, seq FROM (
  SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS rn FROM r)
WHERE rn % 5 = 0
""")
def every_fifth_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Emit every 5th reading of a device."""
    return W.every_nth(_readings(spark, sf), KEYS, ORDER, 5).select("device_id", "seq")


@query("look_ahead_target", f"""
WITH r AS ({EVENT_READINGS_SQL})
SELECT a.device_id, a.seq, round(b.signal, 6) AS target_signal
FROM r a LEFT JOIN LATERAL (
  SELECT signal FROM r b WHERE b.device_id = a.device_id AND b.ts > a.ts + INTERVAL 3600 SECOND
  ORDER BY b.ts, b.seq LIMIT 1) b ON true
""")
def look_ahead_target(spark: SparkSession, sf: str) -> DataFrame:
    """Training target = the reading of the same device at the first
    time strictly more than the horizon (1 h here, 5 s for IGBT) later,
    however late it comes."""
    return asof_forward_value(_readings(spark, sf), KEYS, "ts", "seq", ["signal"], 3600.0).select(
        "device_id", "seq", rnd("next_signal", 6).alias("target_signal"))


# ------------------------------------------------------------------ stats back to rows

@query("signal_outliers", f"""
WITH r AS ({EVENT_READINGS_SQL}),
st AS (SELECT device_id, avg(signal) AS mu, stddev_pop(signal) AS sd FROM r GROUP BY device_id),
m AS (SELECT avg(signal) AS mean_all FROM r)
SELECT r.device_id, r.seq, round(coalesce(r.signal, m.mean_all), 6) AS filled,
       abs(r.signal - st.mu) > 3.0 * st.sd AS outlier,
       round(r.signal - st.mu, 6) AS residual
FROM r JOIN st USING (device_id), m
""")
def signal_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """P14 mean fill (J4 table stats back to rows), P13 per-device 3-sigma
    band, F10 residual against the device mean."""
    df = _readings(spark, sf)
    df = df.withColumn("filled", F.col("signal"))
    df = fill_mean(df, ["filled"])
    df = sigma_band(df, KEYS, "signal", k=3.0, flag="outlier")
    mu = df.groupBy(*KEYS).agg(F.avg("signal").alias("_mu"))
    df = join_small(df, mu, KEYS, "left").withColumn("residual", F.col("signal") - F.col("_mu"))
    return df.select("device_id", "seq", rnd("filled", 6).alias("filled"), "outlier",
                     rnd("residual", 6).alias("residual"))


# ------------------------------------------------------------------ joins

@query("state_risk_lookup", """
SELECT event_type, coalesce(CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium'
                                            WHEN 'view' THEN 'low' END, 'unknown') AS risk,
       count(*) AS n
FROM events GROUP BY ALL
""")
def state_risk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """State -> risk dimension lookup with an ``unknown`` default."""
    e = read_table(spark, sf, "events")
    # The state -> risk dimension.
    e = lookup(e, "event_type", {"error": "high", "purchase": "medium", "view": "low"}, "risk",
               default="unknown")
    return e.groupBy("event_type", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("asof_last_view", """
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS view_ts, max_by(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.user_id, p.event_id, v.view_ts AS asof_view_ts, round(v.view_value, 6) AS asof_view_value
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND v.view_ts <= p.ts
""")
def asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase, the latest view of the same user at or before
    it (as-of join)."""
    e = read_table(spark, sf, "events")
    p = e.filter(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")
    v = e.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"), F.col("event_id").alias("view_id"))
    j = asof_backward(p, v, ["user_id"], "ts", "view_ts", ["view_ts", "view_value"], seq_left="event_id", seq_right="view_id")
    return j.select("user_id", "event_id", "asof_view_ts",
                    rnd("asof_view_value", 6).alias("asof_view_value"))


@query("hourly_aligned_signals", """
WITH b AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, value FROM events),
v AS (SELECT user_id, bucket, avg(value) AS view_avg FROM b WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT user_id, bucket, avg(value) AS click_avg FROM b WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT user_id, bucket, avg(value) AS purchase_avg FROM b WHERE event_type = 'purchase' GROUP BY ALL),
j AS (SELECT user_id, bucket, view_avg, click_avg, purchase_avg FROM v FULL JOIN c USING (user_id, bucket) FULL JOIN p USING (user_id, bucket))
SELECT user_id, bucket, round(view_avg, 6) AS view_avg, round(click_avg, 6) AS click_avg,
       round(last_value(purchase_avg IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket), 6) AS purchase_last
FROM j
""")
def hourly_aligned_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Three sensors of different rates on one hourly grid per device;
    buckets with one of them stay, the slow one is carried forward."""
    out = align_signals(read_table(spark, sf, "events"), ["user_id"], "ts", "event_type", "value",
                        {"view": "view_avg", "click": "click_avg", "purchase": "purchase_last"}, period="1 hour", carry=["purchase_last"])
    return out.select("user_id", "bucket", *[rnd(c, 6).alias(c) for c in ("view_avg", "click_avg", "purchase_last")])


# ------------------------------------------------------------------ alerting

def _cooldown_sql(gate: str, key: str, seconds: int) -> str:
    return f"""
WITH RECURSIVE g AS (SELECT user_id, event_type, ts, event_id, value FROM events WHERE {gate}),
nx AS (SELECT a.event_id, (SELECT b.event_id FROM g b WHERE {' AND '.join(f'b.{k} = a.{k}' for k in key.split(','))}
                              AND b.ts > a.ts + INTERVAL {seconds} SECOND ORDER BY b.ts, b.event_id LIMIT 1) AS next_id
       FROM g a),
starts AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn
                                 FROM g) WHERE rn = 1),
chain(event_id) AS (SELECT event_id FROM starts
                    UNION ALL SELECT nx.next_id FROM chain JOIN nx USING (event_id) WHERE nx.next_id IS NOT NULL)
SELECT g.user_id, g.event_type, g.ts AS alert_ts,
       'device ' || CAST(g.user_id AS VARCHAR) || ' ' || g.event_type || ' at ' || strftime(g.ts, '%Y-%m-%d %H:%M:%S')
         AS message
FROM chain JOIN g USING (event_id)
"""


def _cooldown(spark, sf, gate, keys, seconds) -> DataFrame:
    e = read_table(spark, sf, "events").filter(gate)
    fired = cooldown_fired(e, keys, "ts", "event_id", seconds)
    return alert_records(fired, "user_id", "ts", "event_type")


@query("alert_cooldown_errors", _cooldown_sql("event_type = 'error'", "user_id", 21600))
def alert_cooldown_errors(spark: SparkSession, sf: str) -> DataFrame:
    """T4 gate (errors) -> T3 cool-down of 6 h per device -> S6 alert rows."""
    return _cooldown(spark, sf, F.col("event_type") == "error", ["user_id"], 21600)


@query("alert_cooldown_states", _cooldown_sql("event_type IN ('error', 'signup')", "user_id,event_type", 600))
def alert_cooldown_states(spark: SparkSession, sf: str) -> DataFrame:
    """T3 with the pump monitor's key (device, state) and the 600 s window."""
    return _cooldown(spark, sf, F.col("event_type").isin("error", "signup"), ["user_id", "event_type"], 600)


@query("alert_cooldown_global", _cooldown_sql("event_type = 'error'", "user_id", 21600)
       .replace("b.user_id = a.user_id", "TRUE").replace("PARTITION BY user_id ORDER", "ORDER"))
def alert_cooldown_global(spark: SparkSession, sf: str) -> DataFrame:
    """T3 with one clock for the whole site (leak and shearer monitors)."""
    return _cooldown(spark, sf, F.col("event_type") == "error", [], 21600)


@query("alert_cooldown_unknown_devices", _cooldown_sql("event_type = 'error'", "user_id", 21600)
       .replace("SELECT user_id, event_type", "SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, event_type", 1)
       .replace("b.user_id = a.user_id", "coalesce(b.user_id, -1) = coalesce(a.user_id, -1)")
       .replace("CAST(g.user_id AS VARCHAR)", "coalesce(CAST(g.user_id AS VARCHAR), 'unknown')"))
def alert_cooldown_unknown_devices(spark: SparkSession, sf: str) -> DataFrame:
    """T3 where a third of the devices is not known: they share the NULL key."""
    e = read_table(spark, sf, "events").filter(F.col("event_type") == "error")
    e = e.withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    fired = cooldown_fired(e, ["user_id"], "ts", "event_id", 21600)
    named = alert_records(fired.withColumn("device", F.coalesce(F.col("user_id").cast("string"), F.lit("unknown"))),
                          "device", "ts", "event_type")
    return named.select(F.col("device").try_cast("long").alias("user_id"), "event_type", "alert_ts", "message")


@query("alert_replay_suppressed", """
WITH g AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'),
a AS (SELECT user_id, ts AS at FROM events WHERE event_type = 'signup')
SELECT g.user_id, g.event_id FROM g
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = g.user_id AND a.at <= g.ts
                  AND g.ts <= a.at + INTERVAL 3600 SECOND)
""")
def alert_replay_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """J5 (batch replay): error candidates not covered by an earlier alert
    (here: signups act as alerts) within the last hour."""
    e = read_table(spark, sf, "events")
    cands = e.filter(F.col("event_type") == "error").select("user_id", "ts", "event_id")
    alerts = e.filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("at"))
    # "within the window" is inclusive: not suppressed means strictly beyond it
    kept = not_yet_alerted(cands, alerts, ["user_id"], "ts", "at", 3600)
    return kept.select("user_id", "event_id")


# ------------------------------------------------------------------ period profiles

@query("fault_frequency", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS period_start, count(*) AS n_readings,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_faults
FROM events GROUP BY ROLLUP (user_id, time_bucket(INTERVAL 1 DAY, ts))
""")
def fault_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Faults per device and day with device and grand totals (rollup)."""
    e = read_table(spark, sf, "events")
    return A.fault_frequency(e, "user_id", "ts", F.col("event_type") == "error")


@query("recent_state_counts", """
SELECT event_type, count(*) AS n, CAST(count_if(value > 100) AS BIGINT) AS n_high
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
GROUP BY event_type
""")
def recent_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A16 last 7 days + A9 threshold count per state."""
    e = A.recent(read_table(spark, sf, "events"), "ts", 7)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if(F.col("value") > 100).alias("n_high"))


@query("distinct_states", "SELECT DISTINCT event_type FROM events")
def distinct_states(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct classes."""
    return A.distinct_classes(read_table(spark, sf, "events"), "event_type")


@query("scatter_temperature_ripple", f"""
WITH r AS ({EVENT_READINGS_SQL})
SELECT round(temperature, 6) AS x, round(ripple, 6) AS y, state AS cls FROM r WHERE signal IS NOT NULL
""")
def scatter_temperature_ripple(spark: SparkSession, sf: str) -> DataFrame:
    """Scatter points (temperature x ripple by state), all points."""
    r = event_readings(spark, sf).filter(F.col("signal").isNotNull())
    p = A.scatter_points(r, "temperature", "ripple", "state")
    return p.select(rnd("x", 6).alias("x"), rnd("y", 6).alias("y"), "cls")


@query("top_readings", """
SELECT event_id, user_id, round(value, 6) AS value FROM events ORDER BY value DESC, event_id LIMIT 10
""")
def top_readings(spark: SparkSession, sf: str) -> DataFrame:
    """O3: top-10 report (ordered limit; partial top-k per task)."""
    e = read_table(spark, sf, "events")
    return (e.orderBy(F.col("value").desc(), F.col("event_id")).limit(10)
             .select("event_id", "user_id", rnd("value", 6).alias("value")))


@query("first_of_each_state", """
SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS first_ts FROM events GROUP BY event_type
""")
def first_of_each_state(spark: SparkSession, sf: str) -> DataFrame:
    """First sample of each class (``min_by`` -- a partial aggregate, no
    sort of the class)."""
    e = read_table(spark, sf, "events")
    return e.groupBy("event_type").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("first_ts"))


@query("class_frames_union", """
SELECT fault, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM (
  SELECT l_quantity, 0 AS fault FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT l_quantity, 1 AS fault FROM lineitem WHERE l_returnflag = 'R')
GROUP BY fault
""")
def class_frames_union(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class frames tagged with a literal label and stacked."""
    li = read_table(spark, sf, "lineitem")
    normal = li.filter(F.col("l_returnflag") == "N").select("l_quantity", F.lit(0).alias("fault"))
    fault = li.filter(F.col("l_returnflag") == "R").select("l_quantity", F.lit(1).alias("fault"))
    u = normal.unionByName(fault)
    return u.groupBy("fault").agg(F.count(F.lit(1)).alias("n"),
                                  rnd(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query("signal_band_power", """
WITH x AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS period_start, value,
                  CAST(row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) - 1 AS DOUBLE) AS n,
                  CAST(count(*) OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts)) AS DOUBLE) AS nn
           FROM events),
g AS (SELECT user_id, period_start, count(*) AS n,
             sum(value * cos(2.0 * 3.141592653589793 * 1 * n / nn)) AS re1, sum(value * sin(2.0 * 3.141592653589793 * 1 * n / nn)) AS im1,
             sum(value * cos(2.0 * 3.141592653589793 * 2 * n / nn)) AS re2, sum(value * sin(2.0 * 3.141592653589793 * 2 * n / nn)) AS im2
      FROM x GROUP BY user_id, period_start)
SELECT user_id, period_start, n, round(re1 * re1 + im1 * im1, 4) AS power_1, round(re2 * re2 + im2 * im2, 4) AS power_2
FROM g
""")
def signal_band_power(spark: SparkSession, sf: str) -> DataFrame:
    """DFT band power (first two harmonics) per device and day."""
    e = read_table(spark, sf, "events")
    b = A.band_power(e, ["user_id"], ["ts", "event_id"], "value", period="1 day", harmonics=2)
    return b.select("user_id", "period_start", "n", rnd("power_1", 4).alias("power_1"),
                    rnd("power_2", 4).alias("power_2"))
