"""Cleaning and profiling queries on the pump view of ``lineitem``
(P2-P12, U3, A1-A3, A6-A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rnd

from ..functions.encoding import encode_label
from ..functions.expressions import clip
from ..operators import profile as A
from ..operators.quality import DEDUP, QualityRules, in_range, not_null, null_profile, one_of, positive
from ..sources.schemas import PUMP_CLASSES
from .registry import query
from .views import PUMP_READINGS_SQL, pump_readings

PUMP_COLS = ["flow", "head", "power", "vibration", "state"]

# Pump cleaning chain in the reference's order.
PUMP_RULES = QualityRules([
    not_null(*PUMP_COLS),
    positive("flow", "head", "power"),
    in_range("vibration", 0.0, 10.0, "vibration_range"),
    one_of("state", PUMP_CLASSES, "state_whitelist"),
    DEDUP,
])

_REASON_SQL = f"""
WITH r AS ({PUMP_READINGS_SQL}),
f AS (
  SELECT *, CASE
      WHEN flow IS NULL OR head IS NULL OR power IS NULL OR vibration IS NULL OR state IS NULL THEN 'null'
      WHEN NOT (flow > 0 AND head > 0 AND power > 0) THEN 'positive'
      WHEN NOT (vibration BETWEEN 0 AND 10) THEN 'vibration_range'
      WHEN state NOT IN ('normal', 'wear', 'cavitation') THEN 'state_whitelist' END AS reason
  FROM r),
g AS (SELECT flow, head, power, vibration, state, reason, count(*) AS c FROM f
      GROUP BY flow, head, power, vibration, state, reason),
clean AS (SELECT flow, head, power, vibration, state FROM g WHERE reason IS NULL)"""


@query("pump_quality_report", _REASON_SQL + """,
steps AS (SELECT reason AS step, c AS n FROM g WHERE reason IS NOT NULL
          UNION ALL SELECT 'duplicate', c - 1 FROM g WHERE reason IS NULL
          UNION ALL SELECT 'kept', 1 FROM g WHERE reason IS NULL),
dim AS (SELECT * FROM (VALUES ('null', 0), ('positive', 1), ('vibration_range', 2),
                              ('state_whitelist', 3), ('duplicate', 4), ('kept', 5)) t(step, step_no))
SELECT d.step, d.step_no, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_rows
FROM dim d LEFT JOIN steps s ON s.step = d.step GROUP BY d.step, d.step_no
""")
def pump_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """P6 + P11: rows removed by each step of the chain, counted as the
    sequential masks would, in one pass."""
    return PUMP_RULES.report(pump_readings(spark, sf))


@query("pump_clean_rows", _REASON_SQL + """
SELECT flow, head, power, vibration, state FROM clean
""")
def pump_clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P3 + P7 + P8 + P9 + P10: the cleaned table."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    return clean


@query("pump_rejects", _REASON_SQL + """
SELECT flow, head, power, vibration, state, reason AS reject_reason, CAST(c AS BIGINT) AS n_rows
FROM g WHERE reason IS NOT NULL
UNION ALL
SELECT flow, head, power, vibration, state, 'duplicate', CAST(c - 1 AS BIGINT) FROM g
WHERE reason IS NULL AND c > 1
""")
def pump_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The rejected rows with the reason (and the number of copies)."""
    _, rejects = PUMP_RULES.apply(pump_readings(spark, sf))
    return rejects


@query("pump_null_profile", f"""
WITH r AS ({PUMP_READINGS_SQL})
SELECT 'flow' AS "column", CAST(count_if(flow IS NULL OR isnan(flow)) AS BIGINT) AS n_null FROM r
UNION ALL SELECT 'head', CAST(count_if(head IS NULL OR isnan(head)) AS BIGINT) FROM r
UNION ALL SELECT 'power', CAST(count_if(power IS NULL OR isnan(power)) AS BIGINT) FROM r
UNION ALL SELECT 'vibration', CAST(count_if(vibration IS NULL OR isnan(vibration)) AS BIGINT) FROM r
UNION ALL SELECT 'state', CAST(count_if(state IS NULL) AS BIGINT) FROM r
""")
def pump_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values per column."""
    return null_profile(pump_readings(spark, sf), PUMP_COLS)


@query("pump_label_encoding", f"""
WITH r AS ({PUMP_READINGS_SQL})
SELECT state, CASE state WHEN 'normal' THEN 0 WHEN 'wear' THEN 1 WHEN 'cavitation' THEN 2 END AS label,
       count(*) AS n
FROM r GROUP BY ALL
""")
def pump_label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Code-order label encoding; unknown states map to NULL."""
    df = pump_readings(spark, sf).withColumn("label", encode_label("state", PUMP_CLASSES))
    return df.groupBy("state", "label").agg(F.count(F.lit(1)).alias("n"))


@query("pump_clipped", f"""
WITH r AS ({PUMP_READINGS_SQL})
SELECT state,
       round(sum(CASE WHEN flow IS NULL THEN NULL ELSE least(greatest(flow, 60.0), 140.0) END), 6) AS flow_clipped,
       round(sum(greatest(power, 0.0)), 6) AS power_floor,
       round(sum(greatest(head, 10.0)), 6) AS head_floor,
       count(*) AS n
FROM r GROUP BY state
""")
def pump_clipped(spark: SparkSession, sf: str) -> DataFrame:
    """``clip(lo, hi)``, ``np.maximum(x, 10)``, ``max(0, x)``."""
    df = pump_readings(spark, sf)
    return df.groupBy("state").agg(
        rnd(F.sum(clip("flow", 60.0, 140.0)), 6).alias("flow_clipped"),
        rnd(F.sum(clip("power", lo=0.0)), 6).alias("power_floor"),
        rnd(F.sum(clip("head", lo=10.0)), 6).alias("head_floor"),
        F.count(F.lit(1)).alias("n"))


@query("pump_describe", _REASON_SQL + """
SELECT c AS "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS "min", round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS "max"
FROM (SELECT 'flow' AS c, flow AS v FROM clean UNION ALL SELECT 'head', head FROM clean
      UNION ALL SELECT 'power', power FROM clean UNION ALL SELECT 'vibration', vibration FROM clean)
GROUP BY c
""")
def pump_describe(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on the cleaned table (exact linear percentiles)."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    d = A.describe(clean, ["flow", "head", "power", "vibration"])
    return d.select("column", "count", *[rnd(c, 6).alias(c) for c in ["mean", "std"]], "min",
                    *[rnd(c, 6).alias(c) for c in ["p25", "p50", "p75"]], "max")


_CORR_COLS = ["flow", "head", "power", "vibration"]
_CORR_SQL = _REASON_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + ("CAST(1.0 AS DOUBLE) AS corr" if a == b else f"round(corr({a}, {b}), 6) AS corr FROM clean")
    for a in _CORR_COLS for b in _CORR_COLS)


@query("pump_correlation", _CORR_SQL)
def pump_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """A2: Pearson correlation of every feature pair."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    c = A.correlation_matrix(clean, ["flow", "head", "power", "vibration"])
    return c.select("col_a", "col_b", rnd("corr", 6).alias("corr"))


@query("pump_class_shares", _REASON_SQL + """
SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM clean GROUP BY state
""")
def pump_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A3: class counts and shares after cleaning."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    return A.class_counts(clean, "state").withColumn("share", rnd("share", 6))


def _hist_sql(src: str, cls: str, val: str, bins: int) -> str:
    return f"""
, x AS (SELECT {cls} AS cls, CAST({val} AS DOUBLE) AS v FROM {src} WHERE {val} IS NOT NULL),
rng AS (SELECT cls, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM x GROUP BY cls),
b AS (SELECT x.cls, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin
      FROM x JOIN rng USING (cls))
SELECT cls AS {cls}, bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY cls, bin, lo, hi
"""


@query("pump_histogram", _REASON_SQL + _hist_sql("clean", "state", "flow", 30))
def pump_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """30-bin flow histogram per class on the class's own range."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    h = A.histogram(clean, "flow", "state", bins=30)
    return h.select("state", "bin", rnd("bin_lo", 6).alias("bin_lo"),
                    rnd("bin_hi", 6).alias("bin_hi"), "n")


@query("pump_raw_vs_clean_histogram", _REASON_SQL + """,
stacked AS (SELECT 'raw' AS source, vibration FROM r UNION ALL SELECT 'clean', vibration FROM clean)
""" + _hist_sql("stacked", "source", "vibration", 50))
def pump_raw_vs_clean_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + U2: raw and cleaned vibration stacked with a source literal,
    50 bins each."""
    raw = pump_readings(spark, sf)
    clean, _ = PUMP_RULES.apply(raw)
    both = (raw.select(F.lit("raw").alias("source"), "vibration")
               .unionByName(clean.select(F.lit("clean").alias("source"), "vibration")))
    h = A.histogram(both, "vibration", "source", bins=50)
    return h.select("source", "bin", rnd("bin_lo", 6).alias("bin_lo"),
                    rnd("bin_hi", 6).alias("bin_hi"), "n")


@query("pump_box_stats", _REASON_SQL + """,
long AS (SELECT state, 'flow' AS feature, flow AS value FROM clean
         UNION ALL SELECT state, 'head', head FROM clean
         UNION ALL SELECT state, 'power', power FROM clean
         UNION ALL SELECT state, 'vibration', vibration FROM clean),
q AS (SELECT state, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM long GROUP BY state, feature)
SELECT state, feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(mean, 6) AS mean,
       min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_lo,
       max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_hi,
       CAST(count_if(NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM long JOIN q USING (state, feature)
GROUP BY state, feature, q1, median, q3, mean
""")
def pump_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Box-plot numbers per class x feature."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    b = A.box_stats(clean, "state", ["flow", "head", "power", "vibration"])
    return b.select("state", "feature", *[rnd(c, 6).alias(c) for c in ["q1", "median", "q3", "mean"]],
                    "whisker_lo", "whisker_hi", "n_outliers")


# ------------------------------------------------------------------ compressor chain

from ..operators.quality import predicate  # noqa: E402
from .views import LEAK_READINGS_SQL, leak_readings  # noqa: E402

LEAK_COLS = ["pressure", "supply_flow", "demand_flow", "flow_diff", "flow_ratio", "state"]

# Compressor cleaning chain in the reference's order.
LEAK_RULES = QualityRules([
    not_null(*LEAK_COLS),
    in_range("pressure", 0.4, 0.9, "pressure_range"),
    positive("supply_flow", "demand_flow", name="flow_positive"),
    predicate("flow_diff_nonneg", lambda: F.col("flow_diff") >= 0),
    in_range("flow_ratio", 1.0, 100.0, "flow_ratio_range"),
    one_of("state", ["normal", "leak"], "state_whitelist"),
    DEDUP,
])


def leak_rows(spark, sf):
    from ..functions import features as X

    r = leak_readings(spark, sf)
    return r.select("pressure", "supply_flow", "demand_flow",
                    X.flow_diff("supply_flow", "demand_flow").alias("flow_diff"),
                    X.flow_ratio("supply_flow", "demand_flow").alias("flow_ratio"), "state")


@query("leak_quality_report", f"""
WITH r AS ({LEAK_READINGS_SQL}),
d AS (SELECT pressure, supply_flow, demand_flow, supply_flow - demand_flow AS flow_diff,
             supply_flow / (demand_flow + 1e-5) AS flow_ratio, state FROM r),
f AS (SELECT *, CASE
      WHEN pressure IS NULL OR supply_flow IS NULL OR demand_flow IS NULL OR flow_diff IS NULL
           OR flow_ratio IS NULL OR state IS NULL THEN 'null'
      WHEN NOT (pressure BETWEEN 0.4 AND 0.9) THEN 'pressure_range'
      WHEN NOT (supply_flow > 0 AND demand_flow > 0) THEN 'flow_positive'
      WHEN NOT (flow_diff >= 0) THEN 'flow_diff_nonneg'
      WHEN NOT (flow_ratio BETWEEN 1 AND 100) THEN 'flow_ratio_range'
      WHEN state NOT IN ('normal', 'leak') THEN 'state_whitelist' END AS reason FROM d),
g AS (SELECT pressure, supply_flow, demand_flow, flow_diff, flow_ratio, state, reason, count(*) AS c
      FROM f GROUP BY ALL),
steps AS (SELECT reason AS step, c AS n FROM g WHERE reason IS NOT NULL
          UNION ALL SELECT 'duplicate', c - 1 FROM g WHERE reason IS NULL
          UNION ALL SELECT 'kept', 1 FROM g WHERE reason IS NULL),
dim AS (SELECT * FROM (VALUES ('null', 0), ('pressure_range', 1), ('flow_positive', 2), ('flow_diff_nonneg', 3),
                              ('flow_ratio_range', 4), ('state_whitelist', 5), ('duplicate', 6), ('kept', 7)) t(step, step_no))
SELECT d.step, d.step_no, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_rows
FROM dim d LEFT JOIN steps s ON s.step = d.step GROUP BY d.step, d.step_no
""")
def leak_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """P11 compressor chain: null -> pressure -> flow -> diff -> ratio ->
    label -> dedup, with the rows each step removes."""
    return LEAK_RULES.report(leak_rows(spark, sf))


@query("pump_standardized", _REASON_SQL + """,
st AS (SELECT avg(flow) AS mf, stddev_pop(flow) AS sf, avg(vibration) AS mv, stddev_pop(vibration) AS sv FROM clean)
SELECT state, round(sum((flow - mf) / sf), 6) AS sum_flow_z, round(max((flow - mf) / sf), 6) AS max_flow_z,
       round(min((vibration - mv) / sv), 6) AS min_vibration_z, count(*) AS n
FROM clean, st GROUP BY state
""")
def pump_standardized(spark: SparkSession, sf: str) -> DataFrame:
    """population z-scores of the cleaned features (exact parity with
    the reference's scaler; ML ``StandardScaler`` uses the sample sigma)."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    z = A.standard_scale(clean, ["flow", "vibration"])
    return z.groupBy("state").agg(rnd(F.sum("flow_z"), 6).alias("sum_flow_z"),
                                  rnd(F.max("flow_z"), 6).alias("max_flow_z"),
                                  rnd(F.min("vibration_z"), 6).alias("min_vibration_z"),
                                  F.count(F.lit(1)).alias("n"))


@query("label_shape_report", """
SELECT count(*) AS n_rows, 3 AS n_columns, round(avg(quality), 6) AS label_mean FROM labels
""")
def label_shape_report(spark: SparkSession, sf: str) -> DataFrame:
    """Table shape and label mean."""
    from ..sources.readers import read_table

    r = A.shape_report(read_table(spark, sf, "labels"), "quality")
    return r.select("n_rows", "n_columns", rnd("label_mean", 6).alias("label_mean"))
