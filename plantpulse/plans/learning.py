"""Model jobs on the driver tables (M1-M19, O1, O4, S8, A10-A14 on model
output). Tree models are not reproducible across libraries, so these get
the rows-only check (plus metric floors in the tests); the closed-form
per-device fits are SQL-checkable."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import rules as R
from ..functions.expressions import rnd
from ..operators import ensembles as EN
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import split as S
from ..operators import trees as TR
from ..operators.joins import join_small, reconcile
from ..operators.quality import fill_mean
from ..operators.windows import micros_of, rolling_std
from ..session import materialize, scratch_path
from ..sources.model_registry import ModelRegistry
from ..sources.readers import read_table
from ..sources.schemas import FEATURES, LEAK_CLASSES, PUMP_CLASSES
from ..sources.sinks import load_model, save_model
from .cleaning import PUMP_RULES
from .health import health_windows
from .registry import query
from .views import leak_readings, pump_readings, shearer_readings, temperature_readings

_MODELS: dict = {}

# A unique row key of lineitem (the first four columns alone repeat at sf0.001)
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _cached(name: str, sf: str, build):
    """Fitted models are reused by the queries of one Spark application (a
    fit is the expensive part; scoring is a lazy plan). A new application
    refits, so no model outlives the context it was fitted in."""
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    app = active.sparkContext.applicationId if active is not None else None
    key = (name, sf, app)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def _report(scored: DataFrame, label: str, classes) -> DataFrame:
    rep = M.classification_report(scored, label, "prediction", classes)
    return rep.select("row", *[rnd(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


# ------------------------------------------------------------------ shearer (binary RF)

def _shearer(spark, sf):
    df = shearer_readings(spark, sf).withColumn(
        "fault", R.shearer_fault_rule("vibration", "temperature", "oil_quality"))
    return S.split_flag(df.withColumn("label", F.col("fault").cast("double")), LINE_KEY, 0.2)


def shearer_model(spark, sf):
    def build():
        d = _shearer(spark, sf).filter(~F.col("is_test"))
        pipe = ML.pipeline(FEATURES["shearer"], ML.forest_classifier(100, 10, 42))
        return ML.fit(pipe, d)
    return _cached("shearer", sf, build)


@query("shearer_fault_forest")
def shearer_fault_forest(spark: SparkSession, sf: str) -> DataFrame:
    """P18 label -> M1 hash split -> M10 scaler + M5 RF(100, 10) -> A12
    classification report on the hold-out."""
    model = shearer_model(spark, sf)
    test = _shearer(spark, sf).filter(F.col("is_test"))
    return _report(ML.scored(model, test), "label", [0.0, 1.0])


@query("shearer_feature_importance")
def shearer_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Impurity importances, highest first."""
    return ML.importances(shearer_model(spark, sf), FEATURES["shearer"])


@query("shearer_confusion")
def shearer_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + A11 + M14: confusion cells and alarm counts at thresholds 0.3 /
    0.5 / 0.7 on the positive-class probability."""
    s = ML.scored(shearer_model(spark, sf), _shearer(spark, sf).filter(F.col("is_test")))
    p1 = F.col("probs")[1]
    out = None
    for thr in (0.3, 0.5, 0.7):
        t = s.withColumn("pred", F.when(p1 > thr, 1.0).otherwise(0.0))
        c = M.confusion_long(t, "label", "pred", [0.0, 1.0]).withColumn("threshold", F.lit(thr))
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------------------------------ pump (3-class RF)

def _noisy(rule, classes: int, *keys: str):
    """A rule's class code, replaced by another one for every fiftieth key."""
    u = S.unit_hash(*keys, salt="noise")
    return F.when(u < 0.02, (rule + 1) % classes).otherwise(rule).cast("double")


def _pump(spark, sf):
    """Cleaned pump readings with a state that follows the physics (vibration
    grows with wear, head falls with cavitation) and 2 % wrong labels. Readings
    are distinct after cleaning, so a hash of the reading splits them."""
    clean, _ = PUMP_RULES.apply(pump_readings(spark, sf))
    clean = clean.dropDuplicates(["flow", "head", "power", "vibration"])
    key = ["flow", "head", "power", "vibration"]
    state = F.when(F.col("head") < 46.0, 2).when(F.col("vibration") > 6.5, 1).otherwise(0)
    df = clean.withColumns({
        "efficiency_index": X.efficiency_index("flow", "head", "power"),
        "specific_power": X.specific_power("power", "flow"),
        "label": _noisy(state, 3, *key)})
    return S.split_flag(df, key, 0.2)


def pump_model(spark, sf):
    def build():
        pipe = ML.pipeline(FEATURES["pump"], ML.forest_classifier(100, 30, 42))
        return ML.fit(pipe, _pump(spark, sf).filter(~F.col("is_test")))
    return _cached("pump", sf, build)


@query("pump_state_forest")
def pump_state_forest(spark: SparkSession, sf: str) -> DataFrame:
    """P11 clean -> F1/F2 -> M2 stratified split -> scaler + RF(100) ->
    A12 report (macro-F1 is the headline metric)."""
    s = ML.scored(pump_model(spark, sf), _pump(spark, sf).filter(F.col("is_test")), classes=PUMP_CLASSES)
    return _report(s, "label", [0.0, 1.0, 2.0])


@query("pump_scored_alerts")
def pump_scored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """M13 + O2 + R7 + R8 + R16: scored readings with class name, confidence,
    risk, advice and the alert trigger, counted per outcome."""
    s = ML.scored(pump_model(spark, sf), _pump(spark, sf), classes=PUMP_CLASSES)
    s = s.withColumns({"risk": R.pump_risk("predicted_class"),
                       "advice": R.pump_advice("predicted_class", "confidence"),
                       "alert": R.confidence_trigger("predicted_class", "confidence")})
    return s.groupBy("predicted_class", "risk", "advice", "alert").agg(F.count(F.lit(1)).alias("n"))


# The forests' search grid. No limit on the depth is MLlib's
# largest, 30; MLlib has no least number of rows to split a node (2, 5, 10).
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [8, 10, 12, 30], "minInstancesPerNode": [1, 2, 4]}

#: The points of it that the pump's query searches (run times: README, known limits).
QUERY_GRID = {"numTrees": [50, 100], "maxDepth": [8, 10], "minInstancesPerNode": [1, 2]}


def _grid_rows(res: DataFrame) -> DataFrame:
    return res.select("point", "params", rnd("metric", 6).alias("metric"),
                      rnd("metric_std", 6).alias("metric_std"), "best")


@query("pump_grid_search")
def pump_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """M11 + M12 + O4: 5-fold CV (hash folds) over a part of the grid, weighted
    F1; the best point is flagged."""
    d = S.fold_id(_pump(spark, sf).filter(~F.col("is_test")), ["flow", "head", "power", "vibration"], 5)
    rf = ML.forest_classifier(100, 10, 42)
    pipe = ML.pipeline(FEATURES["pump"], rf)
    _, res = ML.cross_validate(pipe, ML.param_grid(rf, **QUERY_GRID), ML.weighted_f1(), d, parallelism=4)
    return _grid_rows(res)


@query("pump_boosted_ovr")
def pump_boosted_ovr(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient-boosted trees one-vs-rest for the 3 pump classes."""
    d = _pump(spark, sf)
    pipe = ML.pipeline(FEATURES["pump"], ML.boosted_one_vs_rest(100, 5))
    model = _cached("pump_ovr", sf, lambda: ML.fit(pipe, d.filter(~F.col("is_test"))))
    s = model.transform(d.filter(F.col("is_test")))
    return _report(s, "label", [0.0, 1.0, 2.0])


# ------------------------------------------------------------------ leak (balanced RF)

def _leak(spark, sf):
    """Cleaned compressor readings; a leak shows as lost flow (2 % wrong
    labels). Weights come from the training side."""
    df = leak_readings(spark, sf).withColumns({
        "flow_diff": X.flow_diff("supply_flow", "demand_flow"),
        "flow_ratio": X.flow_ratio("supply_flow", "demand_flow")})
    df = df.filter((F.col("pressure") >= 0.4) & (F.col("pressure") <= 0.9) & (F.col("flow_diff") >= 0))
    key = ["l_orderkey", "l_linenumber", "supply_flow"]
    leak = F.when(F.col("flow_ratio") > 1.03, 1).otherwise(0)
    df = S.split_flag(df.withColumn("label", _noisy(leak, 2, *key)), key, 0.2)
    return S.class_weights(df, "label", train=~F.col("is_test"))


@query("leak_balanced_forest")
def leak_balanced_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M4 balanced class weights -> RF(100, 10) -> confusion (A10) with missed
    leaks and false alarms (A11)."""
    d = _leak(spark, sf)
    pipe = ML.pipeline(FEATURES["leak"], ML.forest_classifier(100, 10, 42, weight_col="weight"))
    model = _cached("leak", sf, lambda: ML.fit(pipe, d.filter(~F.col("is_test"))))
    s = ML.scored(model, d.filter(F.col("is_test")), classes=LEAK_CLASSES)
    cells = M.confusion_long(s, "label", "prediction", [0.0, 1.0])
    alarms = s.agg(*M.alarm_count_cols("label", "prediction", 1.0, 0.0))
    return join_small(cells, alarms, F.lit(True), "inner").select("label", "prediction", "n", "missed", "false_alarms")


# ------------------------------------------------------------------ temperature (GBT) / IGBT / linear

def _temperature(spark, sf):
    df = temperature_readings(spark, sf)
    y = X.temperature_baseline("temp_current", "vibration_x", "vibration_y", "current", "voltage",
                               "pressure", "humidity")
    return S.split_flag(df.withColumn("label", y), ["l_orderkey", "l_linenumber", "humidity"], 0.2)


@query("temperature_boosted")
def temperature_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """M8 + F13 + F14: scaler -> degree-2 expansion -> GBT(200, 5, 0.1) ->
    A13 metrics on train and test."""
    d = _temperature(spark, sf)
    pipe = ML.pipeline(FEATURES["temperature"], ML.boosted_regressor(200, 5, 0.1, 5), poly_degree=2)
    model = _cached("temperature", sf, lambda: ML.fit(pipe, d.filter(~F.col("is_test"))))
    s = model.transform(d)
    out = None
    for side, flag in (("train", False), ("test", True)):
        m = M.regression_metrics(s.filter(F.col("is_test") == flag), "label", "prediction")
        m = m.select(F.lit(side).alias("split"), "n", *[rnd(c, 6).alias(c) for c in ["r2", "mse", "mae", "rmse"]])
        out = m if out is None else out.unionByName(m)
    return out


@query("igbt_forest")
def igbt_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M6: RF regressor (100, 10, sqrt) on the IGBT formula target -> A13."""
    li = read_table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber",
                  (F.lit(2.0) * F.col("l_quantity")).alias("current"),
                  (F.lit(1000.0) + F.col("l_partkey") % 1000).cast("double").alias("frequency"),
                  (F.lit(20.0) + F.lit(100.0) * F.col("l_tax")).alias("ambient_temp"),
                  (F.col("l_linenumber") / F.lit(4.0) - F.lit(0.5)).alias("temp_rate"),
                  (F.lit(10.0) * F.col("l_discount")).alias("load_factor"))
    d = d.withColumn("label", X.igbt_baseline("current", "load_factor", "ambient_temp", "temp_rate"))
    d = S.split_flag(d, ["l_orderkey", "l_linenumber", "current"], 0.2)
    pipe = ML.pipeline(FEATURES["igbt"], ML.forest_regressor(100, 10, 42, subset="sqrt"))
    model = _cached("igbt", sf, lambda: ML.fit(pipe, d.filter(~F.col("is_test"))))
    m = M.regression_metrics(model.transform(d.filter(F.col("is_test"))), "label", "prediction")
    return m.select("n", *[rnd(c, 6).alias(c) for c in ["r2", "mse", "mae", "rmse"]])


@query("simple_temperature_linear")
def simple_temperature_linear(spark: SparkSession, sf: str) -> DataFrame:
    """M9: OLS with intercept on the 3-feature linear formula (coefficients
    recover 0.5 / 0.3 / 0.2 / 10)."""
    d = temperature_readings(spark, sf).select(
        F.col("temp_current").alias("temp"), "vibration_x", "current")
    d = d.withColumn("label", X.simple_temperature("temp", "vibration_x", "current"))
    model = ML.fit(ML.pipeline(FEATURES["simple_temperature"], ML.linear_regressor(), scale=False), d)
    lr = model.stages[-1]
    rows = [(n, float(c)) for n, c in zip(FEATURES["simple_temperature"], lr.coefficients.toArray())]
    rows.append(("intercept", float(lr.intercept)))
    return spark.createDataFrame(rows, "term string, coefficient double") \
                .select("term", rnd("coefficient", 4).alias("coefficient"))


# ------------------------------------------------------------------ inverter (2-output RF on windows)

@query("inverter_two_output_forest")
def inverter_two_output_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M7: one RF regressor (100, 10, all features) per target on the shared
    W1 window table; A13 life MAE + A14 thermal accuracy on a time-ordered
    hold-out (last 20 % of days)."""
    # read by the cut, two fits and two reports
    w = materialize(health_windows(spark, sf), "inverter-windows")
    # time-ordered hold-out: the last fifth of the readings (one row of a cut)
    us = micros_of(w, "ts")
    cut = w.agg(F.percentile_approx(us, 0.8, 10_000).alias("_cut"))
    w = w.join(F.broadcast(cut)).withColumn("is_test", us > F.col("_cut")).drop("_cut")
    feats = FEATURES["inverter"]
    out = None
    for target in ("life_pct", "thermal_risk"):
        pipe = ML.pipeline(feats, ML.forest_regressor(100, 10, 42, subset="all"), scale=False, label=target)
        model = _cached(f"inverter_{target}", sf, lambda p=pipe: ML.fit(p, w.filter(~F.col("is_test"))))
        s = model.transform(w.filter(F.col("is_test")))
        m = M.regression_metrics(s, target, "prediction").withColumn("target", F.lit(target))
        t = M.thresholded_accuracy(s, target, "prediction", 0.5).select(F.col("accuracy").alias("thermal_accuracy"))
        m = join_small(m, t, F.lit(True), "inner")  # one row each
        out = m if out is None else out.unionByName(m)
    return out.select("target", "n", *[rnd(c, 6).alias(c) for c in ["r2", "mse", "mae", "rmse", "thermal_accuracy"]])


def life_search(d: DataFrame, features, targets, life: str, grid: dict, *, parallelism: int = 8):
    """M7 + M11 + M12: one forest per target with shared parameters, searched by
    the error of the life target alone. Targets are fitted apart from each other,
    so the folds fit the one that is scored; the best point is fitted for all. With
    several sizes in the grid, the points of a fold share their trees."""
    rf = ML.forest_regressor(100, 10, 42, subset="all").setFeaturesCol("_raw")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"),
                            EN.MultiTarget(rf, [life])])
    others = [t for t in targets if t != life]

    def all_targets(best, train, params):
        assembler, scored = best.stages
        more = EN.MultiTarget(rf, others).fit(assembler.transform(train), params)
        members = dict(zip([life, *others], [*scored.members, *more.members]))
        return PipelineModel([assembler, EN.MultiTargetModel([members[t] for t in targets], targets)])
    points = ML.param_grid(rf, **grid)

    def shared_trees(table, fold_col, folds):
        return TR.search_errors(rf, points, table, features, life, fold_col, folds)
    return ML.cross_validate(pipe, points, EN.TargetMAE(life), d, parallelism=parallelism, finish=all_targets,
                             measure=shared_trees if len(grid.get("numTrees", ())) > 1 else None)


@query("inverter_life_search")
def inverter_life_search(spark: SparkSession, sf: str) -> DataFrame:
    """M12 + O4: 5-fold CV of the two-output forest over the whole grid, by the
    mean absolute error of the life; the best point is flagged."""
    d = S.fold_id(health_windows(spark, sf), ["device_id", "ts", "seq"], 5)
    _, res = life_search(d, FEATURES["inverter"], ["life_pct", "thermal_risk"], "life_pct", FOREST_GRID)
    return _grid_rows(res)


# ------------------------------------------------------------------ belt (soft voting)

@query("belt_soft_voting")
def belt_soft_voting(spark: SparkSession, sf: str) -> DataFrame:
    """RF + GBT + logistic regression, averaged probabilities, arg-max."""
    li = read_table(spark, sf, "lineitem")
    d = li.select(*LINE_KEY,
                  (F.lit(100.0) + F.lit(0.8) * F.col("l_quantity")).alias("current"),
                  (F.lit(10.0) * F.col("l_tax")).alias("speed_diff"),
                  (F.col("l_quantity") / F.lit(5.0)).alias("vibration"),
                  (F.lit(40.0) + F.lit(600.0) * F.col("l_discount")).alias("temperature"))
    d = d.withColumn("label", F.when((F.col("speed_diff") > 0.5) & (F.col("vibration") > 5.0), 1.0)
                              .otherwise(0.0))
    d = S.split_flag(d, LINE_KEY, 0.2)
    feats = FEATURES["belt_slip"]
    members = {"rf": ML.forest_classifier(200, 8, 42),
               "gbt": GBTClassifier(maxIter=200, maxDepth=8, seed=42),
               "lr": ML.logistic(50)}
    test = d.filter(F.col("is_test"))
    fitted = [_cached(f"belt_{name}", sf, lambda e=est: ML.fit(ML.pipeline(feats, e, scale=True),
                                                               d.filter(~F.col("is_test"))))
              for name, est in members.items()]
    vote = EN.VotingModel(fitted).transform(test)
    return _report(vote, "label", [0.0, 1.0])


# ------------------------------------------------------------------ belt (forests)

def _belt_readings(spark, sf):
    """Belt sensors per line, one belt per supplier, in order of shipping."""
    li = read_table(spark, sf, "lineitem")
    return li.select(*LINE_KEY, "l_shipdate",
                     (F.lit(100.0) + F.lit(0.8) * F.col("l_quantity")).alias("current"),
                     (F.lit(10.0) * F.col("l_tax")).alias("speed_diff"),
                     (F.col("l_quantity") / F.lit(5.0)).alias("vibration"),
                     (F.lit(40.0) + F.lit(600.0) * F.col("l_discount")).alias("temperature"))


def _belt_slip(spark, sf):
    slip = ((F.col("speed_diff") > 0.5) & (F.col("vibration") > 5.0)).cast("int")
    return S.split_flag(_belt_readings(spark, sf).withColumn("label", _noisy(slip, 2, *LINE_KEY)), LINE_KEY, 0.2)


@query("belt_slip_forest")
def belt_slip_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M5 RF(100, 8) on current, speed gap, vibration and temperature; the
    label is slipping, 2 % of it wrong -> A12 report on the hold-out."""
    d = _belt_slip(spark, sf)
    model = _cached("belt_slip", sf, lambda: ML.fit(
        ML.pipeline(FEATURES["belt_slip"], ML.forest_classifier(100, 8, 42)), d.filter(~F.col("is_test"))))
    return _report(ML.scored(model, d.filter(F.col("is_test"))), "label", [0.0, 1.0])


def _belt_fault(spark, sf):
    """The current's swing over five readings of the belt (W3), its missing
    first value filled with the mean (P14); faults are slipping, a swinging
    current at high temperature, or a hot shaking bearing."""
    d = rolling_std(_belt_readings(spark, sf), ["l_suppkey"], ["l_shipdate", *LINE_KEY], "current", "current_std", size=5)
    d = fill_mean(d, ["current_std"]).withColumnsRenamed(
        {"vibration": "vibration_motor", "temperature": "temperature_bearing"})
    hot = F.col("temperature_bearing") > 80
    fault = (((F.col("speed_diff") > 0.5) & (F.col("vibration_motor") > 5.0)) | ((F.col("current_std") > 12) & hot)
             | ((F.col("vibration_motor") > 8) & hot)).cast("int")
    return S.split_flag(d.withColumn("label", _noisy(fault, 2, *LINE_KEY)), LINE_KEY, 0.2)


@query("belt_fault_forest")
def belt_fault_forest(spark: SparkSession, sf: str) -> DataFrame:
    """W3 + P14 -> M5 RF(200, 8) on five features -> A12 report on the hold-out."""
    d = _belt_fault(spark, sf)
    model = _cached("belt_fault", sf, lambda: ML.fit(
        ML.pipeline(FEATURES["belt_fault"], ML.forest_classifier(200, 8, 42)), d.filter(~F.col("is_test"))))
    return _report(ML.scored(model, d.filter(F.col("is_test"))), "label", [0.0, 1.0])


# ------------------------------------------------------------------ embeddings

@query("embedding_forest")
def embedding_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M5 on 64-d embedding vectors (10 classes) -> A12 report."""
    e = read_table(spark, sf, "embeddings")
    d = e.select("vec_id", ML.vectors_from_array("embedding").alias("_raw"),
                 F.col("label").cast("double").alias("label"))
    d = S.split_flag(d, ["vec_id"], 0.2)
    rf = ML.forest_classifier(100, 10, 42).setFeaturesCol("_raw").setLabelCol("label")
    model = _cached("embedding", sf, lambda: ML.fit(Pipeline(stages=[rf]), d.filter(~F.col("is_test"))))
    s = model.transform(d.filter(F.col("is_test")))
    return _report(s, "label", [float(i) for i in range(10)])


# ------------------------------------------------------------------ persistence + retrain gate

@query("model_roundtrip_parity")
def model_roundtrip_parity(spark: SparkSession, sf: str) -> DataFrame:
    """S8 + J1: save the shearer pipeline to the shared folder, load it back
    and reconcile the two scorings (must be all-close)."""
    model = shearer_model(spark, sf)
    path = scratch_path(spark, "model-shearer")
    save_model(model, path)
    loaded = load_model(path)
    d = _shearer(spark, sf).filter(F.col("is_test"))
    a = ML.scored(model, d).select(*LINE_KEY, F.col("probs")[1].alias("p_a"))
    b = ML.scored(loaded, d).select(*LINE_KEY, F.col("probs")[1].alias("p_b"))
    summary, _ = reconcile(a, b, LINE_KEY, "p_a", "p_b")
    return summary.select("n_rows", "missing_a", "missing_b", rnd("max_abs_diff", 6).alias("max_abs_diff"),
                          "allclose")


@query("retrain_gate")
def retrain_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate trained with the latest data vs the current model, both
    scored on the same recent hold-out; accepted and saved when macro F1 does
    not drop. Order numbers stand for time in this table."""
    d = _shearer(spark, sf).withColumn("event_day", F.col("l_orderkey"))
    cut = d.agg(F.percentile_approx("event_day", 0.8, 10_000).alias("cut"))  # one row
    d = d.join(F.broadcast(cut))
    older, latest = F.col("event_day") <= F.col("cut"), F.col("event_day") > F.col("cut")
    pipe = lambda: ML.pipeline(FEATURES["shearer"], ML.forest_classifier(100, 10, 42))
    current = _cached("gate_current", sf, lambda: ML.fit(pipe(), d.filter(older & ~F.col("is_test"))))
    candidate = _cached("gate_candidate", sf, lambda: ML.fit(pipe(), d.filter(~F.col("is_test"))))
    registry = ModelRegistry(spark, scratch_path(spark, "models"))
    registry.publish(current)
    verdict = retrain_decision(registry, candidate, d.filter(latest & F.col("is_test")), [0.0, 1.0])
    return spark.createDataFrame([verdict], "f1_current double, f1_candidate double, accept boolean")


def retrain_decision(registry: ModelRegistry, candidate, recent_hold_out: DataFrame, classes):
    """Macro F1 of the registry's current model and of the candidate on the
    recent hold-out; the candidate becomes the current model when it is no worse."""
    def macro_f1(model):
        rep = M.classification_report(model.transform(recent_hold_out), "label", "prediction", classes)
        return round(rep.filter(F.col("row") == "macro avg").first()["f1"], 6)
    return registry.challenge(candidate, macro_f1)


# ------------------------------------------------------------------ closed-form per-device fits

@query("device_linear_fits", """
WITH r AS (SELECT user_id, value AS x, 40.0 + value / 10.0 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0 AS y
           FROM events)
SELECT user_id, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(regr_r2(y, x), 6) AS r2
FROM r GROUP BY user_id
""")
def device_linear_fits(spark: SparkSession, sf: str) -> DataFrame:
    """M18 per-device models / M9 closed form: OLS of temperature on the
    signal for every device, as one aggregation."""
    e = read_table(spark, sf, "events")
    d = e.select("user_id", F.col("value").alias("x"),
                 (F.lit(40.0) + F.col("value") / 10.0
                  + F.get_json_object("props", "$.k").cast("int") / 50.0).alias("y"))
    f = ML.grouped_linear_fit(d, ["user_id"], "y", "x")
    return f.select("user_id", "n", *[rnd(c, 6).alias(c) for c in ["slope", "intercept", "r2"]])
