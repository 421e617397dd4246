"""Sources and sinks: fixed-schema CSV reads of small sample files, NaN normalisation, aliases, JSON, contracts, CSV sink."""

import tempfile

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.quality import check_contract, null_profile
from plantpulse.sources import schemas as S
from plantpulse.sources.readers import apply_aliases, nan_to_null, parse_json, read_csv, to_json_response
from plantpulse.sources.sinks import write_csv
from tests.samples import FILES

SAMPLES = [
    ("temperature.csv", S.TEMPERATURE_SAMPLES),
    ("pump.csv", S.PUMP_SAMPLES),
    ("leak.csv", S.LEAK_SAMPLES),
    ("belt_fault.csv", S.BELT_FAULT_SAMPLES),
    ("belt_slip.csv", S.BELT_SLIP_SAMPLES),
    ("inverter.csv", S.INVERTER_WINDOW_SAMPLES),
]


@pytest.mark.parametrize("name,schema", SAMPLES)
def test_sample_csv_fixed_schema(spark, samples, name, schema):
    rows, repeated, _ = FILES[name]
    df = read_csv(spark, f"{samples}/{name}", schema)
    assert df.count() == rows
    assert rows - df.dropDuplicates().count() == repeated
    assert all(r.n_null == 0 for r in null_profile(df).collect())


def test_leak_sample_derived_columns(spark, samples):
    df = read_csv(spark, f"{samples}/leak.csv", S.LEAK_SAMPLES)
    r = df.agg(F.max(F.abs(F.col("flow_diff") - (F.col("supply_flow") - F.col("demand_flow")))).alias("d"),
               F.max(F.abs(F.col("flow_ratio") - F.col("supply_flow") / F.col("demand_flow"))).alias("q")).first()
    assert r.d < 1e-9 and r.q < 6e-4


def test_nan_to_null_and_aliases(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "SupplyFlow double, DemandFlow double")
    out = apply_aliases(nan_to_null(df))
    assert out.columns == ["supply_flow", "demand_flow"]
    assert [r.supply_flow for r in out.collect()] == [None, 2.0]


def test_json_round_trip(spark):
    df = spark.createDataFrame([('{"current": 120.5, "speed_diff": 0.2}',), ("not json",)], ["body"])
    p = df.select(parse_json("body", "current double, speed_diff double").alias("r"))
    rows = p.select("r.current", "r.speed_diff").collect()
    assert rows[0].current == 120.5 and rows[1].current is None
    out = p.select(to_json_response(status=F.lit("ok"), probability=F.lit(0.5)).alias("j")).first().j
    assert out == '{"status":"ok","probability":0.5}'


def test_contract_check(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, "x")], "flow int, head double, power double, vibration double, z string")
    out = check_contract(df, S.PUMP_SAMPLES)
    assert out.columns == ["flow", "head", "power", "vibration"]
    assert dict(out.dtypes)["flow"] == "double"
    with pytest.raises(ValueError):
        check_contract(df.drop("head"), S.PUMP_SAMPLES)


def test_csv_sink_decodes_labels(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 2)], "flow double, label int")
    out = tempfile.mkdtemp(prefix="pp-csv-")
    write_csv(df, f"{out}/t", label_col="label", classes=S.PUMP_CLASSES)
    back = spark.read.option("header", True).csv(f"{out}/t")
    assert sorted(r.label for r in back.collect()) == ["cavitation", "normal"]
