"""The declarative jobs: train on driver-table views, score sample files and
hand-made readings."""

import pytest
from pyspark.sql import functions as F

from plantpulse import jobs as J
from plantpulse.functions import rules as R
from plantpulse.plans.views import leak_readings, pump_readings, shearer_readings
from plantpulse.sources import schemas as SC
from plantpulse.sources.readers import read_csv, read_table
from tests.conftest import SF_MID, SF_SMALL

def _report(job):
    return {(r.target, r.row): r for r in job.report.collect()}


def test_pump_job_scores_sample_file(spark, samples):
    hist = pump_readings(spark, SF_SMALL).withColumnRenamed("state", "label")
    job = J.train(J.JOBS["pump"], hist)
    rep = _report(job)
    assert ("label", "accuracy") in rep
    samples = read_csv(spark, f"{samples}/pump.csv", SC.PUMP_SAMPLES)
    out = J.score(job, samples).cache()
    assert out.count() == 30
    bad = out.filter(F.col("risk") != R.pump_risk("predicted_class")).count()
    assert bad == 0 and out.filter(F.col("advice").isNull()).count() == 0


def test_leak_job_scores_sample_file(spark, samples):
    hist = leak_readings(spark, SF_SMALL).withColumnRenamed("state", "label")
    job = J.train(J.JOBS["leak"], hist)
    samples = read_csv(spark, f"{samples}/leak.csv", SC.LEAK_SAMPLES)
    out = J.score(job, samples)
    rows = out.select("predicted_class", "risk", "leak_amount").collect()
    assert len(rows) == 50 and all(r.risk in ("low", "medium", "high") for r in rows)


def test_shearer_job_learns_rule_and_flags_golden(spark):
    hist = shearer_readings(spark, SF_MID).withColumn(
        "label", R.shearer_fault_rule("vibration", "temperature", "oil_quality"))
    job = J.train(J.JOBS["shearer"], hist, key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                    "l_extendedprice"])
    assert _report(job)[("label", "accuracy")].precision >= 0.95
    one = spark.createDataFrame([(12.5, 95.0, 180.0, 220.0, 40.0)], SC.FEATURES["shearer"])
    r = J.score(job, one).first()
    assert r.status == "fault" and len(r.risk_factors) == 3


def test_belt_jobs_score_sample_files(spark, samples):
    li = read_table(spark, SF_SMALL, "lineitem")
    base = li.select((F.lit(100.0) + F.lit(0.8) * F.col("l_quantity")).alias("current"),
                     (F.lit(10.0) * F.col("l_tax")).alias("speed_diff"),
                     (F.col("l_quantity") / F.lit(5.0)).alias("vibration"),
                     (F.lit(40.0) + F.lit(600.0) * F.col("l_discount")).alias("temperature"))
    slip = base.withColumn("label", ((F.col("speed_diff") > 0.5) & (F.col("vibration") > 5)).cast("int"))
    job = J.train(J.JOBS["belt_slip"], slip)
    out = J.score(job, read_csv(spark, f"{samples}/belt_slip.csv", SC.BELT_SLIP_SAMPLES))
    assert out.count() == 28 and "grade" in out.columns
    fault = base.select("current", "speed_diff", F.col("vibration").alias("vibration_motor"),
                        F.col("temperature").alias("temperature_bearing"),
                        (F.col("current") / 10.0).alias("current_std"))
    fault = fault.withColumn("label", (F.col("temperature_bearing") > 70).cast("int"))
    job = J.train(J.JOBS["belt_fault"], fault)
    out = J.score(job, read_csv(spark, f"{samples}/belt_fault.csv", SC.BELT_FAULT_SAMPLES))
    assert out.count() == 33 and out.filter(F.col("status").isNull()).count() == 0


def test_inverter_job_on_windows(spark, samples):
    e = read_table(spark, SF_SMALL, "events")
    raw = e.select(F.col("user_id").alias("device_id"), F.col("ts").alias("time"),
                   (F.get_json_object("props", "$.k").cast("double") / 100).alias("load_factor"),
                   (F.lit(40.0) + F.col("value") / 10).alias("temperature"),
                   F.sqrt("value").alias("ripple"),
                   (F.lit(100.0) - F.col("value") / 5).alias("label_life"),
                   (F.col("value") > 100).cast("double").alias("label_thermal"))
    table = J.inverter_training_table(raw, device="device_id", ts="time")
    job = J.train(J.JOBS["inverter"], table)
    assert {r.target for r in job.report.collect()} == {"label_life", "label_thermal"}
    out = J.score(job, read_csv(spark, f"{samples}/inverter.csv", SC.INVERTER_WINDOW_SAMPLES))
    rows = out.select("health_status", "action", "recommendations").collect()
    assert len(rows) == 25 and all(r.health_status in ("healthy", "warning", "abnormal") for r in rows)


def test_simple_temperature_job_recovers_formula(spark):
    from plantpulse.functions import features as X

    df = (spark.range(2000).select((F.col("id") % 37).cast("double").alias("temp"),
                                   (F.col("id") % 11 / 3).cast("double").alias("vibration_x"),
                                   (F.col("id") % 7 * 1.5).cast("double").alias("current"))
                .withColumn("target", X.simple_temperature("temp", "vibration_x", "current")))
    job = J.train(J.JOBS["simple_temperature"], df)
    assert job.report.first().r2 > 0.999999
    r = J.score(job, spark.createDataFrame([(0.5, 0.3, 0.2)], SC.FEATURES["simple_temperature"])).first()
    assert r.prediction == pytest.approx(10.38, abs=1e-6) and r.alarm == "normal"
