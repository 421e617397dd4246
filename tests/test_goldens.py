"""Hand goldens derived from the reference formulas and worked examples."""

import pytest
from pyspark.sql import functions as F

from plantpulse.functions import features as X
from plantpulse.functions import rules as R
from plantpulse.functions.encoding import decode_label, encode_label
from plantpulse.functions.expressions import clip, pct_text, rnd
from plantpulse.operators import metrics as M
from plantpulse.operators import windows as W
from plantpulse.operators.alerts import cooldown_fired
from plantpulse.operators.split import class_weights
from plantpulse.sources.schemas import PUMP_CLASSES


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols.keys()))


def test_pump_features(spark):
    r = one(spark, flow=110.0, head=55.0, power=50.0).select(
        X.efficiency_index("flow", "head", "power").alias("e"),
        X.specific_power("power", "flow").alias("s")).first()
    assert r.e == pytest.approx(120.999998, abs=1e-6)
    assert r.s == pytest.approx(0.454545, abs=1e-6)


def test_leak_features_and_risk(spark):
    r = one(spark, p=0.68, s=480.0, d=400.0, state="leak").select(
        X.flow_diff("s", "d").alias("diff"), X.flow_ratio("s", "d").alias("ratio"),
        X.leak_estimate("p", "s", "d").alias("est"), X.leak_amount("s", "d").alias("amt"),
        R.leak_risk("state", X.leak_amount("s", "d")).alias("risk")).first()
    assert r.diff == 80.0
    assert r.ratio == pytest.approx(1.19999997, abs=1e-8)
    assert r.est == pytest.approx(78.857143, abs=1e-6)
    assert r.amt == 80.0 and r.risk == "high"


def test_leak_estimate_normal_loss(spark):
    r = one(spark, p=0.7, s=420.0, d=400.0).select(X.leak_estimate("p", "s", "d").alias("e")).first()
    assert r.e == 0.0


def test_temperature_formulas(spark):
    r = one(spark, t=25.0, vx=2.0, vy=2.5, cur=5.0, v=230.0, p=100.0, h=50.0).select(
        X.temperature_baseline("t", "vx", "vy", "cur", "v", "p", "h").alias("y")).first()
    assert r.y == pytest.approx(31.0954, abs=1e-4)
    r = one(spark, t=0.5, vx=0.3, cur=0.2).select(X.simple_temperature("t", "vx", "cur").alias("y")).first()
    assert r.y == pytest.approx(10.38, abs=1e-9)


def test_igbt_formula_and_alarm(spark):
    r = one(spark, cur=50.0, amb=35.0, rate=0.5, load=0.7).select(
        X.igbt_baseline("cur", "load", "amb", "rate").alias("y")).first()
    assert r.y == pytest.approx(87.0)
    alarms = one(spark, a=85.0, b=87.0, c=100.0, d=100.5).select(
        *[R.igbt_alarm(c).alias(c) for c in "abcd"]).first()
    assert tuple(alarms) == ("ok", "caution", "caution", "warn")


def test_shearer_rule_and_factors(spark):
    df = one(spark, vib=12.5, temp=95.0, cur=180.0, pres=220.0, oil=40.0)
    r = df.select(R.shearer_fault_rule("vib", "temp", "oil").alias("fault"),
                  R.shearer_risk_factors("vib", "temp", "cur", "oil").alias("f")).first()
    assert r.fault == 1
    got = [(f.factor, f.severity) for f in r.f]
    assert got == [("vibration too high", "high"), ("temperature too high", "medium"),
                   ("oil quality poor", "high")]


def test_rule_boundaries(spark):
    vals = [0.3, 0.7, 0.9, 50.0, 80.0, 85.0, 95.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], ["x"])
    out = {r.x: r for r in df.select(
        "x", R.temperature_alarm("x").alias("t"), R.thermal_band(F.col("x")).alias("tb"),
        R.belt_status(F.lit(1), "x").alias("b"), R.inverter_health(F.lit(90.0), "x").alias("h")).collect()}
    assert out[50.0].t == "normal" and out[80.0].t == "high"
    assert out[0.3].tb == "elevated" and out[0.7].tb == "elevated" and out[0.9].tb == "high"
    assert out[0.9].b == "fault warning: inspect soon" and out[0.7].b == "suspected anomaly: keep monitoring"
    assert out[0.3].h == "warning"


def test_inverter_recommendations(spark):
    r = one(spark, life=45.0, risk=0.8).select(
        R.inverter_recommendations("life", "risk").alias("rec"),
        R.maintenance_action("life", "risk").alias("act"),
        R.inverter_health("life", "risk").alias("h")).first()
    assert len(r.rec) == 4 and r.act == "replace capacitors now" and r.h == "abnormal"
    r = one(spark, life=95.0, risk=0.1).select(R.inverter_recommendations("life", "risk").alias("rec")).first()
    assert r.rec == ["running normally: keep monitoring"]


def test_rolling_std_goldens(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([135, 138, 142, 140, 139])]
    df = spark.createDataFrame(rows, "dev int, seq int, cur double").withColumn(
        "ts", F.timestamp_seconds(F.col("seq")))
    df = W.rolling_std(df, ["dev"], ["ts", "seq"], "cur", "s", size=5, ddof=1)
    df = W.rolling_std(df, ["dev"], ["ts", "seq"], "cur", "p", size=5, ddof=0, min_n=2)
    last = df.orderBy(F.col("seq").desc()).first()
    first = df.orderBy("seq").first()
    assert last.s == pytest.approx(2.588436, abs=1e-6)
    assert last.p == pytest.approx(2.315167, abs=1e-6)
    assert first.s is None and first.p == 0.0


def test_lagged_window_drops_first_20(spark):
    df = (spark.range(5000).select(F.lit(1).alias("dev"), F.col("id").alias("seq"),
                                   F.timestamp_seconds(F.col("id") * 7).alias("ts"),
                                   (F.col("id") % 13).cast("double").alias("t"),
                                   (F.col("id") % 5).cast("double").alias("r"),
                                   F.lit(0.5).alias("l")))
    out = W.lagged_window_features(df, ["dev"], ["ts", "seq"], ripple="r", temperature="t", load="l",
                                   chunk_seconds=3600)
    assert out.count() == 4980


def test_label_encoding(spark):
    df = spark.createDataFrame([("normal",), ("wear",), ("cavitation",), ("other",), (None,)], ["s"])
    r = df.select(encode_label("s", PUMP_CLASSES).alias("i")).collect()
    assert [x.i for x in r] == [0, 1, 2, None, None]
    back = spark.createDataFrame([(0,), (2,), (7,)], ["i"]).select(decode_label("i", PUMP_CLASSES).alias("s"))
    assert [x.s for x in back.collect()] == ["normal", "cavitation", None]


def test_clip_and_percent(spark):
    df = spark.createDataFrame([(5.0,), (150.0,), (None,)], "x double")
    got = [r.c for r in df.select(clip("x", 10.0, 100.0).alias("c")).collect()]
    assert got == [10.0, 100.0, None]
    assert one(spark, p=0.12345).select(pct_text("p").alias("t")).first().t == "12.35%"


def test_rounding_matches_half_away(spark):
    df = spark.createDataFrame([(42.9222395,), (-2.5e-6,), (1.0000005,)], "x double")
    got = [r.y for r in df.select(rnd("x", 6).alias("y")).collect()]
    assert got == [42.92224, -3e-06, 1.000001]


def test_class_weights_balanced(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 5600, 0).otherwise(1).alias("y"))
    w = {r.y: r.weight for r in class_weights(df, "y").distinct().collect()}
    assert w[0] == pytest.approx(0.714286, abs=1e-6) and w[1] == pytest.approx(1.666667, abs=1e-6)


def test_classification_report_golden(spark):
    cells = [(0, 0, 1370), (0, 1, 30), (1, 0, 48), (1, 1, 552)]
    rows = [(t, p) for t, p, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "label int, pred int")
    rep = {r.row: r for r in M.classification_report(df, "label", "pred", [0, 1]).collect()}
    assert rep["accuracy"].precision == pytest.approx(0.961)
    assert rep["1"].precision == pytest.approx(0.948454, abs=1e-6)
    assert rep["1"].recall == pytest.approx(0.92)
    assert rep["0"].precision == pytest.approx(0.966150, abs=1e-6)
    assert rep["0"].recall == pytest.approx(0.978571, abs=1e-6)
    cm = M.confusion_long(df, "label", "pred", [0, 1])
    assert sum(r.n for r in cm.collect()) == 2000


def test_cooldown_golden(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 100, 650, 700, 1300])]
    df = spark.createDataFrame(rows, "dev int, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for rows_ in (None, 2):
        fired = sorted(r.s for r in cooldown_fired(df, ["dev"], "ts", "id", 600, chunk_rows=rows_).collect())
        assert fired == [0, 650, 1300]


def test_cooldown_strict_boundary(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 599, 600, 601, 1202])]
    df = spark.createDataFrame(rows, "dev int, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for rows_ in (None, 2):
        fired = sorted(r.s for r in cooldown_fired(df, ["dev"], "ts", "id", 600, chunk_rows=rows_).collect())
        assert fired == [0, 601, 1202]
