"""Declarative jobs: the reference's nine model jobs as specs.

A ``JobSpec`` bundles the input contract (P19), the cleaning chain (P11),
the derived features (F*), the feature vector, the model (M*) and the rule
layer on its output (R*). ``train`` fits it on any table with the contract
(a driver-table view, a CSV, a Parquet history) and reports hold-out
metrics; ``score`` applies the fitted pipeline plus the rules to a batch *or*
a stream (stateless, T1).

    spec = JOBS["pump"]
    fitted = train(spec, history_df)
    statuses = score(spec, fitted, new_readings_df)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import features as X
from .functions import rules as R
from .functions.encoding import decode_label, encode_label
from .operators import metrics as M
from .operators import models as ML
from .operators import split as S
from .operators.quality import (DEDUP, QualityRules, check_contract, in_range, not_null, one_of, positive,
                                predicate)
from .operators.windows import lagged_window_features, rolling_std
from .sources import schemas as SC
from .sources.readers import apply_aliases, nan_to_null


def _identity(df: DataFrame) -> DataFrame:
    return df


def _pump_derive(df: DataFrame) -> DataFrame:
    return df.withColumns({"efficiency_index": X.efficiency_index("flow", "head", "power"),
                           "specific_power": X.specific_power("power", "flow")})


def _leak_derive(df: DataFrame) -> DataFrame:
    # derived columns are always recomputed (shipped ratios are rounded)
    return df.withColumns({"flow_diff": X.flow_diff("supply_flow", "demand_flow"),
                           "flow_ratio": X.flow_ratio("supply_flow", "demand_flow")})


def _belt_derive(df: DataFrame) -> DataFrame:
    if "speed_diff" not in df.columns and {"speed_head", "speed_tail"} <= set(df.columns):
        df = df.withColumn("speed_diff", X.speed_gap("speed_head", "speed_tail"))
    return df


def _pump_status(df: DataFrame) -> DataFrame:
    return df.withColumns({"risk": R.pump_risk("predicted_class"),
                           "advice": R.pump_advice("predicted_class", "confidence"),
                           "alert": R.confidence_trigger("predicted_class", "confidence")})


def _leak_status(df: DataFrame) -> DataFrame:
    amount = X.leak_amount("supply_flow", "demand_flow")
    return df.withColumns({"leak_amount": amount,
                           "leak_estimate": X.leak_estimate("pressure", "supply_flow", "demand_flow"),
                           "risk": R.leak_risk("predicted_class", amount)})


def _shearer_status(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "status": R.binary_status(F.col("prediction").cast("int")),
        "risk": R.shearer_risk(F.when(F.col("prediction") == 1, "fault").otherwise("normal"), "confidence"),
        "risk_factors": R.shearer_risk_factors("vibration", "temperature", "current", "oil_quality"),
        "alert": (F.col("prediction") == 1) & (F.col("confidence") > 0.8)})


def _belt_status(df: DataFrame) -> DataFrame:
    p1 = F.col("probs")[1]
    return df.withColumns({"status": R.belt_status(F.col("prediction").cast("int"), p1)})


def _slip_status(df: DataFrame) -> DataFrame:
    p1 = F.col("probs")[1]
    return df.withColumns({"grade": R.slip_grade(F.col("prediction").cast("int"), p1),
                           "power_est": X.belt_power("current")})


def _temperature_status(df: DataFrame) -> DataFrame:
    return df.withColumn("alarm", R.temperature_alarm("prediction"))


def _igbt_status(df: DataFrame) -> DataFrame:
    return df.withColumn("alarm", R.igbt_alarm("prediction"))


def _inverter_status(df: DataFrame) -> DataFrame:
    life, risk = "pred_label_life", "pred_label_thermal"
    return df.withColumns({
        "health_status": R.inverter_health(life, risk), "life_band": R.life_band(life),
        "thermal_band": R.thermal_band(risk), "recommendations": R.inverter_recommendations(life, risk),
        "action": R.maintenance_action(life, risk)})


@dataclass(frozen=True)
class JobSpec:
    name: str
    features: list[str]
    targets: list[str]                         # one model per target (M7)
    model: Callable[[], object]
    classes: list[str] | None = None           # classification: class names in code order
    rules: Callable[[], QualityRules] | None = None
    derive: Callable[[DataFrame], DataFrame] = _identity
    status: Callable[[DataFrame], DataFrame] = _identity
    scale: bool = True
    poly_degree: int | None = None
    weighted: bool = False                     # balanced class weights (M4)
    stratified: bool = False                   # M2 instead of M1
    test_fraction: float = 0.2
    raw: list[str] = field(default_factory=list)   # inputs a caller must provide
    derived_from: dict[str, list[str]] = field(default_factory=dict)  # inputs that others can stand for
    impute: bool = False                       # missing features take their training means (P14)
    # the raw training table (``training_table``)
    history: T.StructType | None = None        # its columns (P19)
    history_rules: Callable[[], QualityRules] | None = None   # cleaning before windows
    windows: Callable[[DataFrame, list[str], list[str]], DataFrame] | None = None
    labels: dict[str, str] = field(default_factory=dict)      # its label column -> target


def _pump_rules() -> QualityRules:
    # Pump cleaning chain.
    return QualityRules([not_null("flow", "head", "power", "vibration"),
                         positive("flow", "head", "power"),
                         in_range("vibration", 0.0, 10.0, "vibration_range"),
                         one_of("label", SC.PUMP_CLASSES, "label_whitelist"), DEDUP])


def _leak_rules() -> QualityRules:
    # Compressor cleaning chain.
    return QualityRules([not_null("pressure", "supply_flow", "demand_flow"),
                         in_range("pressure", 0.4, 0.9, "pressure_range"),
                         positive("supply_flow", "demand_flow", name="flow_positive"),
                         predicate("flow_diff_nonneg", lambda: F.col("flow_diff") >= 0),
                         in_range("flow_ratio", 1.0, 100.0, "flow_ratio_range"),
                         one_of("label", SC.LEAK_CLASSES, "label_whitelist"), DEDUP])


def _inverter_rules() -> QualityRules:
    # Inverter cleaning ranges (on the windowed table's labels).
    return QualityRules([not_null("label_life", "label_thermal"), DEDUP,
                         in_range("label_life", 0.0, 100.0, "life_range"),
                         in_range("label_thermal", 0.0, 1.0, "thermal_range")])


def _inverter_history_rules() -> QualityRules:
    # Inverter cleaning ranges, all applied before the windows.
    return QualityRules([not_null(*SC.INVERTER_RAW.names), DEDUP,
                         in_range("load_factor", 0.0, 1.0, "load_range"),
                         in_range("temperature", -50.0, 150.0, "temperature_range"),
                         in_range("ripple", 0.0, 50.0, "ripple_range"),
                         in_range("label_life", 0.0, 100.0, "life_range"),
                         in_range("label_thermal", 0.0, 1.0, "thermal_range")])


def _inverter_windows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Features of the 20 readings before, labels of the current one."""
    return lagged_window_features(df, keys, order, ripple="ripple", temperature="temperature", load="load_factor")


def _belt_windows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current swing, the sample deviation of the last five currents (NULL
    for a first reading; the job fills it with the mean)."""
    return rolling_std(df, keys, order, "current", "current_std", size=5, ddof=1, min_n=1)


JOBS: dict[str, JobSpec] = {
    "temperature": JobSpec("temperature", SC.FEATURES["temperature"], ["target"],
                           lambda: ML.boosted_regressor(200, 5, 0.1, 5), poly_degree=2,
                           status=_temperature_status, raw=SC.FEATURES["temperature"]),
    "simple_temperature": JobSpec("simple_temperature", SC.FEATURES["simple_temperature"], ["target"],
                                  ML.linear_regressor, scale=False, status=_temperature_status,
                                  raw=SC.FEATURES["simple_temperature"]),
    "pump": JobSpec("pump", SC.FEATURES["pump"], ["label"], lambda: ML.forest_classifier(100, 30, 42),
                    classes=SC.PUMP_CLASSES, rules=_pump_rules, derive=_pump_derive, status=_pump_status,
                    stratified=True, raw=["flow", "head", "power", "vibration"], history=SC.PUMP_TRAIN),
    "leak": JobSpec("leak", SC.FEATURES["leak"], ["label"], lambda: ML.forest_classifier(100, 10, 42),
                    classes=SC.LEAK_CLASSES, rules=_leak_rules, derive=_leak_derive, status=_leak_status,
                    weighted=True, stratified=True, test_fraction=0.2, raw=["pressure", "supply_flow", "demand_flow"],
                    history=SC.LEAK_TRAIN),
    "shearer": JobSpec("shearer", SC.FEATURES["shearer"], ["label"], lambda: ML.forest_classifier(100, 10, 42),
                       classes=SC.BINARY_CLASSES, status=_shearer_status, raw=SC.FEATURES["shearer"],
                       history=SC.SHEARER, labels={"fault": "label"}),
    "belt_fault": JobSpec("belt_fault", SC.FEATURES["belt_fault"], ["label"],
                          lambda: ML.forest_classifier(200, 8, 42), classes=SC.BINARY_CLASSES,
                          derive=_belt_derive, status=_belt_status, raw=SC.FEATURES["belt_fault"],
                          derived_from={"speed_diff": ["speed_head", "speed_tail"]}, impute=True,
                          history=SC.BELT_FAULT_RAW, windows=_belt_windows, labels={"fault": "label"}),
    "belt_slip": JobSpec("belt_slip", SC.FEATURES["belt_slip"], ["label"], lambda: ML.forest_classifier(100, 8, 42),
                         classes=SC.BINARY_CLASSES, scale=False, status=_slip_status,
                         raw=SC.FEATURES["belt_slip"], history=SC.BELT_SLIP),
    "inverter": JobSpec("inverter", SC.FEATURES["inverter"], ["label_life", "label_thermal"],
                        lambda: ML.forest_regressor(100, 10, 42, subset="all"), rules=_inverter_rules,
                        scale=False, status=_inverter_status, raw=SC.FEATURES["inverter"], history=SC.INVERTER_RAW,
                        history_rules=_inverter_history_rules, windows=_inverter_windows),
    "igbt": JobSpec("igbt", SC.FEATURES["igbt"], ["target"], lambda: ML.forest_regressor(100, 10, 42),
                    status=_igbt_status, raw=SC.FEATURES["igbt"], history=SC.IGBT_TRAIN,
                    labels={"target_temp": "target"}),
}


@dataclass
class FittedJob:
    spec: JobSpec
    models: dict[str, PipelineModel]
    report: DataFrame


def prepare(spec: JobSpec, df: DataFrame) -> DataFrame:
    """Contract + cleaning-free preparation shared by train and score:
    aliases, NaN -> NULL, derived features, float inputs."""
    df = nan_to_null(apply_aliases(df))
    inputs = [x for c in spec.raw for x in ([c] if c in df.columns else spec.derived_from.get(c, [c]))]
    missing = [c for c in inputs if c not in df.columns]
    if missing:
        raise ValueError(f"{spec.name}: input is missing {missing}")
    df = df.withColumns({c: F.col(c).cast("double") for c in inputs})
    return spec.derive(df)


def training_table(spec: JobSpec, history: DataFrame, *, keys: Sequence[str] = (),
                   order: Sequence[str] = ()) -> DataFrame:
    """The job's training table from its raw history: contract (P19), cleaning
    (P11), windowed features (W1, W3), label under the target's name. ``keys``
    name the device (none: one device), ``order`` its readings' order; a job
    with windows needs an order, as rows of a table have none."""
    if spec.history is None:
        raise ValueError(f"{spec.name} has no raw history")
    if spec.windows is not None and not order:
        raise ValueError(f"{spec.name} takes windows over readings: name the columns that order them")
    contract = T.StructType([T.StructField(SC.ALIASES.get(f.name, f.name), f.dataType) for f in spec.history])
    df = nan_to_null(apply_aliases(history))
    own = [df.schema[c] for c in dict.fromkeys([*keys, *order]) if c not in contract.names]
    df = check_contract(df, T.StructType([*contract, *own]))
    if spec.history_rules is not None:
        df, _ = spec.history_rules().apply(df)
    if spec.windows is not None:
        df = spec.windows(df, list(keys), list(order))
    return df.withColumnsRenamed(spec.labels)


def train_history(spec: JobSpec, history: DataFrame, *, keys: Sequence[str] = (), order: Sequence[str] = (),
                  key: Sequence[str] | None = None) -> FittedJob:
    """``train`` on the raw history."""
    return train(spec, training_table(spec, history, keys=keys, order=order), key=key)


def train(spec: JobSpec, df: DataFrame, *, key: Sequence[str] | None = None) -> FittedJob:
    """Clean, split by key hash, fit one pipeline per target and report
    hold-out metrics (A12 for classifiers, A13 for regressors)."""
    df = prepare(spec, df)
    if spec.rules is not None:
        df, _ = spec.rules().apply(df)
    key = list(key) if key else list(spec.features)
    lab = spec.targets[0]
    if spec.classes and dict(df.dtypes).get(lab) == "string":
        df = df.withColumn(lab, encode_label(lab, spec.classes))
    df = df.filter(F.col(lab).isNotNull()).withColumn(lab, F.col(lab).cast("double"))
    df = (S.stratified_flag(df, key, lab, spec.test_fraction) if spec.stratified
          else S.split_flag(df, key, spec.test_fraction))
    weight = None
    if spec.weighted:
        df = S.class_weights(df, lab, train=~F.col("is_test"))
        weight = "weight"
    train_df, test_df = df.filter(~F.col("is_test")), df.filter(F.col("is_test"))
    models, reports = {}, []
    for t in spec.targets:
        est = spec.model()
        if weight:
            est.setWeightCol(weight)
        pipe = ML.pipeline(spec.features, est, scale=spec.scale, poly_degree=spec.poly_degree, label=t,
                           impute=spec.impute)
        models[t] = ML.fit(pipe, train_df)
        scored = models[t].transform(test_df)
        if spec.classes:
            rep = M.classification_report(scored, t, "prediction", [float(i) for i in range(len(spec.classes))])
        else:
            rep = M.regression_metrics(scored, t, "prediction")
        reports.append(rep.withColumn("target", F.lit(t)))
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r, allowMissingColumns=True)
    return FittedJob(spec, models, report)


def score(job: FittedJob, df: DataFrame) -> DataFrame:
    """Score a batch or stream with the fitted pipelines and apply the job's
    rule layer (status, risk, advice, alerts)."""
    spec = job.spec
    out = prepare(spec, df)
    if len(spec.targets) == 1:
        t = spec.targets[0]
        out = ML.scored(job.models[t], out, classes=spec.classes)
        if spec.classes and "predicted_class" not in out.columns:
            out = out.withColumn("predicted_class", decode_label(F.col("prediction").cast("int"), spec.classes))
    else:
        for t in spec.targets:
            out = job.models[t].transform(out).withColumnRenamed("prediction", f"pred_{t}")
            out = out.drop(*[c for c in out.columns if c in ("_raw", "_scaled", "_poly") or c.startswith("_fill_")])
    return spec.status(out)


def label_column(expr: Column, name: str = "label") -> Callable[[DataFrame], DataFrame]:
    """Helper for building training tables: add a label from a rule."""
    return lambda df: df.withColumn(name, expr)


def inverter_training_table(raw: DataFrame, *, device: str = "device_id", ts: str = "time",
                            seq: str | None = None, size: int = 20) -> DataFrame:
    """The inverter job's training table from raw readings
    (load_factor, temperature, ripple, label_life, label_thermal): W1 window
    features over the ``size`` previous readings, labels of the current one."""
    raw = nan_to_null(raw)
    if device not in raw.columns:
        raw = raw.withColumn(device, F.lit(0))
    order = [ts] + ([seq] if seq else [])
    return lagged_window_features(raw, [device], order, ripple="ripple", temperature="temperature",
                                  load="load_factor", size=size, ts_col=ts)
