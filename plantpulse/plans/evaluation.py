"""Evaluation, splits and parity queries (A4, A10-A14, J1, M1, M2, M4, M11,
M14) on driver tables with rule-based predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import rnd

from ..functions import features as X
from ..operators import metrics as M
from ..operators import split as S
from ..operators.joins import reconcile
from ..operators.profile import prediction_distribution
from ..sources.readers import read_table
from ..sources.schemas import PUMP_CLASSES
from .cleaning import PUMP_RULES, _REASON_SQL
from .registry import query
from .views import pump_readings

# ------------------------------------------------------------------ binary: events

_EVENT_PRED_SQL = """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
                  least(1.0, value / 100.0) AS p_fault FROM events),
p AS (SELECT *, CASE WHEN p_fault > 0.5 THEN 1 ELSE 0 END AS prediction FROM s)"""


def event_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Binary truth (``event_type = 'error'``) and a thresholded score."""
    e = read_table(spark, sf, "events")
    s = e.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
                 F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("p_fault"))
    return s.withColumn("prediction", F.when(F.col("p_fault") > 0.5, 1).otherwise(0))


@query("event_confusion", _EVENT_PRED_SQL + """,
dim AS (SELECT * FROM (VALUES (0), (1)) a(label), (VALUES (0), (1)) b(prediction))
SELECT d.label, d.prediction, CAST(count(p.event_id) AS BIGINT) AS n
FROM dim d LEFT JOIN p ON p.label = d.label AND p.prediction = d.prediction
GROUP BY d.label, d.prediction
""")
def event_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """A10: confusion counts, zero cells kept."""
    return M.confusion_long(event_predictions(spark, sf), "label", "prediction", [0, 1])


@query("event_alarm_counts", _EVENT_PRED_SQL + """
SELECT CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS missed,
       CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS false_alarms,
       round(avg(CASE WHEN (label > 0.5) = (p_fault > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM p
""")
def event_alarm_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A11 missed / false alarms + A14 thresholded accuracy."""
    p = event_predictions(spark, sf)
    return p.agg(*M.alarm_count_cols("label", "prediction"),
                 rnd(M.thresholded_accuracy_col("label", "p_fault", 0.5), 6).alias("accuracy"))


@query("event_thresholds", _EVENT_PRED_SQL + """
SELECT CAST(count_if(p_fault > 0.3) AS BIGINT) AS n_at_03, CAST(count_if(p_fault > 0.5) AS BIGINT) AS n_at_05,
       CAST(count_if(p_fault > 0.7) AS BIGINT) AS n_at_07,
       CAST(count_if(label = 1 AND p_fault > 0.3) AS BIGINT) AS tp_at_03,
       CAST(count_if(label = 1 AND p_fault > 0.7) AS BIGINT) AS tp_at_07
FROM p
""")
def event_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Decision thresholds 0.3 / 0.7 instead of 0.5."""
    p = event_predictions(spark, sf)
    c = lambda cond: F.count_if(cond)
    pf, lb = F.col("p_fault"), F.col("label")
    return p.agg(c(pf > 0.3).alias("n_at_03"), c(pf > 0.5).alias("n_at_05"), c(pf > 0.7).alias("n_at_07"),
                 c((lb == 1) & (pf > 0.3)).alias("tp_at_03"), c((lb == 1) & (pf > 0.7)).alias("tp_at_07"))


# ------------------------------------------------------------------ multi-class: pump

def pump_rule_prediction() -> F.Column:
    """Rule-based pump state from the vibration level (the stand-in model)."""
    v = F.col("vibration")
    return F.when(v > 7, "cavitation").when(v > 4, "wear").otherwise("normal")


_PUMP_PRED_SQL = _REASON_SQL + """,
pp AS (SELECT state, CASE WHEN vibration > 7 THEN 'cavitation' WHEN vibration > 4 THEN 'wear'
                          ELSE 'normal' END AS predicted FROM clean)"""


@query("pump_classification_report", _PUMP_PRED_SQL + """,
cm AS (SELECT t.state, p.predicted, (SELECT count(*) FROM pp WHERE pp.state = t.state AND pp.predicted = p.predicted) AS n
       FROM (VALUES ('normal'), ('wear'), ('cavitation')) t(state),
            (VALUES ('normal'), ('wear'), ('cavitation')) p(predicted)),
per AS (SELECT c.cls, sum(CASE WHEN cm.state = c.cls AND cm.predicted = c.cls THEN n ELSE 0 END) AS tp,
               sum(CASE WHEN cm.state = c.cls THEN n ELSE 0 END) AS support,
               sum(CASE WHEN cm.predicted = c.cls THEN n ELSE 0 END) AS n_pred
        FROM cm, (VALUES ('normal'), ('wear'), ('cavitation')) c(cls) GROUP BY c.cls),
m AS (SELECT cls, coalesce(tp / nullif(n_pred, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r,
             support, tp FROM per),
m2 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM m),
tot AS (SELECT sum(support) AS tot, sum(tp) AS tp, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf,
               sum(p * support) AS wp, sum(r * support) AS wr, sum(f1 * support) AS wf FROM m2)
SELECT cls AS "row", round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', round(tp / tot, 6), round(tp / tot, 6), round(tp / tot, 6), CAST(tot AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(tot AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / tot, 6), round(wr / tot, 6), round(wf / tot, 6), CAST(tot AS BIGINT) FROM tot
""")
def pump_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages (from the A10 confusion counts)."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    p = clean.withColumn("predicted", pump_rule_prediction())
    rep = M.classification_report(p, "state", "predicted", PUMP_CLASSES)
    return rep.select("row", *[rnd(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query("pump_prediction_distribution", _PUMP_PRED_SQL + """,
dim AS (SELECT * FROM (VALUES ('normal'), ('wear'), ('cavitation'), ('blocked')) t(predicted))
SELECT d.predicted, CAST(count(pp.predicted) AS BIGINT) AS n
FROM dim d LEFT JOIN pp ON pp.predicted = d.predicted GROUP BY d.predicted
""")
def pump_prediction_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A4: predictions per class, classes never predicted kept at 0."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    p = clean.withColumn("predicted", pump_rule_prediction())
    return prediction_distribution(p, "predicted", PUMP_CLASSES + ["blocked"])


# ------------------------------------------------------------------ regression and parity: events

_EVENT_TEMP_SQL = """
WITH t AS (SELECT event_id, 40.0 + value / 10.0 AS temp,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) / 10.0 AS vib_x, value / 20.0 AS current,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events),
s AS (SELECT event_id, temp + (k - 50) / 100.0 AS y,
             0.5 * temp + 0.3 * vib_x + 0.2 * current + 10.0 AS a,
             CAST(0.5 * CAST(CAST(temp AS FLOAT) AS DOUBLE) + 0.3 * CAST(CAST(vib_x AS FLOAT) AS DOUBLE)
                  + 0.2 * CAST(CAST(current AS FLOAT) AS DOUBLE) + 10.0 AS FLOAT) AS b,
             40.0 + value / 10.0 AS y_hat
      FROM t)"""


def _event_temps(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = e.select("event_id", "value", (F.lit(40.0) + F.col("value") / 10.0).alias("temp"),
                 (k / 10.0).alias("vib_x"), (F.col("value") / 20.0).alias("current"), k.alias("k"))
    f32 = X.as_float32("temp", "vib_x", "current")
    return t.select(
        "event_id",
        (F.col("temp") + (F.col("k") - 50) / 100.0).alias("y"),
        X.simple_temperature("temp", "vib_x", "current").alias("a"),
        X.simple_temperature(f32["temp"].cast("double"), f32["vib_x"].cast("double"),
                             f32["current"].cast("double")).cast("float").alias("b"),
        (F.lit(40.0) + F.col("value") / 10.0).alias("y_hat"))


@query("event_regression_metrics", _EVENT_TEMP_SQL + """
SELECT count(*) AS n, round(1 - sum((y - y_hat) * (y - y_hat)) / (count(*) * var_pop(y)), 6) AS r2,
       round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(avg(abs(y - y_hat)), 6) AS mae,
       round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse
FROM s
""")
def event_regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """R2, MSE, MAE, RMSE."""
    r = M.regression_metrics(_event_temps(spark, sf), "y", "y_hat")
    return r.select("n", *[rnd(c, 6).alias(c) for c in ["r2", "mse", "mae", "rmse"]])


@query("prediction_parity", _EVENT_TEMP_SQL + """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS missing_a, CAST(0 AS BIGINT) AS missing_b,
       round(avg(abs(a - b)), 6) AS mean_abs_diff, round(max(abs(a - b)), 6) AS max_abs_diff,
       CAST(count_if(abs(a - b) > 1e-3) AS BIGINT) AS n_beyond_tol,
       bool_and(abs(a - b) <= 1e-5 + 1e-5 * abs(b)) AS allclose
FROM s
""")
def prediction_parity(spark: SparkSession, sf: str) -> DataFrame:
    """float64 scoring vs float32 scoring, full outer join on event_id."""
    t = _event_temps(spark, sf)
    summary, _ = reconcile(t.select("event_id", "a"), t.select("event_id", F.col("b").cast("double").alias("b")),
                           ["event_id"], "a", "b")
    return summary.select("n_rows", "missing_a", "missing_b",
                          rnd("mean_abs_diff", 6).alias("mean_abs_diff"),
                          rnd("max_abs_diff", 6).alias("max_abs_diff"), "n_beyond_tol", "allclose")


@query("prediction_parity_mismatches", _EVENT_TEMP_SQL + """
SELECT event_id, round(a, 6) AS a, round(b, 6) AS b FROM s WHERE NOT (abs(a - b) <= 1e-5 + 1e-5 * abs(b))
""")
def prediction_parity_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that are not ``allclose``."""
    t = _event_temps(spark, sf)
    _, mism = reconcile(t.select("event_id", "a"), t.select("event_id", F.col("b").cast("double").alias("b")),
                        ["event_id"], "a", "b")
    return mism.select("event_id", rnd("a", 6).alias("a"), rnd("b", 6).alias("b"))


# ------------------------------------------------------------------ splits: labels

@query("label_splits", """
WITH h AS (SELECT doc_id, quality,
                  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
                  CAST(('0x' || substr(md5(CAST(quality AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS us,
                  CAST(('0x' || substr(md5('fold' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS uf
           FROM labels),
c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality)
SELECT doc_id, quality, u < 0.2 AS is_test, us < 0.2 AS is_test_stratified,
       CAST(floor(uf * 5) AS INTEGER) AS fold,
       round((SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * n_c), 6) AS weight
FROM h JOIN c USING (quality)
""")
def label_splits(spark: SparkSession, sf: str) -> DataFrame:
    """M1 hash split, M2 stratified split, M11 fold id, M4 balanced class
    weights."""
    lb = read_table(spark, sf, "labels").select("doc_id", "quality")
    df = S.split_flag(lb, ["doc_id"], 0.2, "is_test")
    df = S.stratified_flag(df, ["doc_id"], "quality", 0.2, "is_test_stratified")
    df = S.fold_id(df, ["doc_id"], 5)
    df = S.class_weights(df, "quality")
    return df.select("doc_id", "quality", "is_test", "is_test_stratified", "fold",
                     rnd("weight", 6).alias("weight"))


@query("label_exact_splits", """
WITH h AS (SELECT doc_id, quality, md5(CAST(doc_id AS VARCHAR)) AS h,
                  md5(concat_ws('|', CAST(quality AS VARCHAR), CAST(doc_id AS VARCHAR))) AS hs FROM labels),
r AS (SELECT *, row_number() OVER (ORDER BY h, CAST(doc_id AS VARCHAR)) AS rn, count(*) OVER () AS n,
             row_number() OVER (PARTITION BY quality ORDER BY hs, CAST(doc_id AS VARCHAR)) AS rs, count(*) OVER (PARTITION BY quality) AS ns
      FROM h)
SELECT doc_id, quality, rn <= ceil(n * 2 / 10.0) AS is_test, ns > 1 AND rs <= ceil(ns * 2 / 10.0) AS is_test_in_class,
       CAST((rs > floor(ns / 5.0))::INT + (rs > floor(ns * 2 / 5.0))::INT + (rs > floor(ns * 3 / 5.0))::INT + (rs > floor(ns * 4 / 5.0))::INT AS INTEGER)
         AS fold
FROM r
""")
def label_exact_splits(spark: SparkSession, sf: str) -> DataFrame:
    """M1 / W10 exact 80/20 split, M2 the same within every class, M11
    stratified folds of equal size."""
    df = read_table(spark, sf, "labels").select("doc_id", "quality")
    df = S.exact_split_flag(df, ["doc_id"], 0.2)
    df = S.exact_split_flag(df, ["doc_id"], 0.2, "quality", "is_test_in_class")
    return S.exact_fold_id(df, ["doc_id"], 5, "quality")


@query("label_split_shares", """
WITH h AS (SELECT quality, toxic,
                  CAST(('0x' || substr(md5(CAST(quality AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS us
           FROM labels)
SELECT quality, us < 0.2 AS is_test, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share_in_class,
       CAST(sum(toxic) AS BIGINT) AS n_toxic
FROM h GROUP BY quality, us < 0.2
""")
def label_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A3 per split side: the stratified split keeps class shares."""
    lb = read_table(spark, sf, "labels")
    df = S.stratified_flag(lb, ["doc_id"], "quality", 0.2, "is_test")
    g = df.groupBy("quality", "is_test").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("toxic").cast("long").alias("n_toxic"))
    return g.withColumn("share_in_class",
                        rnd(F.col("n") / F.sum("n").over(Window.partitionBy("quality")), 6)) \
            .select("quality", "is_test", "n", "share_in_class", "n_toxic")
