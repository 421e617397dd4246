"""Training from the raw history of every job, and what it keeps for scoring."""

import pytest
from pyspark.sql import functions as F

from plantpulse import jobs as J
from plantpulse.operators import models as ML
from plantpulse.sources import schemas as SC


def _small(spec, **changes):
    """The job with few shallow trees: these tests look at the tables."""
    from dataclasses import replace

    model = (lambda: ML.forest_classifier(5, 4, 1)) if spec.classes else (lambda: ML.forest_regressor(5, 4, 1))
    return replace(spec, model=model, **changes)


def _history(spark, spec, n=300):
    """Rows of the raw schema by a rule of the row number."""
    cols = [F.col("id").alias("reading"), (F.col("id") % 3).alias("machine")]
    for i, f in enumerate(spec.history.fields):
        x = (F.col("id") * (i + 3) % 17).cast("double")
        if f.name == "label" and spec.classes:
            names = F.array(*[F.lit(c) for c in spec.classes])
            x = (F.element_at(names, (F.col("id") % len(spec.classes) + 1).cast("int"))
                 if f.dataType.simpleString() == "string" else F.col("id") % 2)
        elif f.name == "fault":
            x = F.col("id") % 2
        elif f.name in ("load_factor", "label_thermal"):
            x = x / 17
        elif f.name in ("SupplyFlow", "DemandFlow"):
            x = F.col("id") % 50 + (60.0 if f.name == "SupplyFlow" else 55.0)
        elif f.name == "FlowDiff":
            x = F.lit(5.0)
        elif f.name == "FlowRatio":
            x = F.lit(1.05)
        elif f.name == "Pressure":
            x = F.lit(0.5) + x / 100
        elif f.name in ("Flow", "Head", "Power"):
            x = x + 1
        elif f.name == "Vibration":
            x = x / 2
        elif f.name == "time":
            x = F.col("id")
        cols.append(x.cast(f.dataType).alias(f.name))
    return spark.range(n).select(*cols)


@pytest.mark.parametrize("name", sorted(n for n, s in J.JOBS.items() if s.history is not None))
def test_every_raw_schema_trains(spark, name):
    spec = _small(J.JOBS[name])
    raw = _history(spark, spec).select("*", F.lit("extra").alias("site"))
    order = ["reading"] if spec.windows else []
    job = J.train_history(spec, raw, keys=["machine"], order=order, key=["reading"] if order else None)
    assert set(job.models) == set(spec.targets)
    assert {r.target for r in job.report.select("target").distinct().collect()} == set(spec.targets)
    table = J.training_table(spec, raw, keys=["machine"], order=order)
    assert set(spec.targets) <= set(table.columns) and "site" not in table.columns


def test_missing_columns_and_orders_are_errors(spark):
    belt = J.JOBS["belt_fault"]
    raw = _history(spark, belt)
    with pytest.raises(ValueError, match="speed_tail"):
        J.training_table(belt, raw.drop("speed_tail"), order=["reading"])
    with pytest.raises(ValueError, match="order"):
        J.training_table(belt, raw)
    with pytest.raises(ValueError, match="no raw history"):
        J.training_table(J.JOBS["temperature"], raw)


def test_inverter_rows_are_cleaned_before_the_windows(spark):
    """A reading out of range is no part of any window."""
    rows = [(t, 0.5, 40.0 + t, 1.0, 90.0, 0.1) for t in range(30)]
    bad = [(100, 0.5, 500.0, 1.0, 90.0, 0.1), (101, 1.5, 41.0, 1.0, 90.0, 0.1), (102, 0.5, 41.0, 60.0, 90.0, 0.1),
           (103, 0.5, 41.0, 1.0, 101.0, 0.1), (104, 0.5, 41.0, 1.0, 90.0, 1.1), (105, None, 41.0, 1.0, 90.0, 0.1),
           (106, 0.5, float("nan"), 1.0, 90.0, 0.1)]
    # bad readings lie between the good ones
    dirty = [(t * 2, *r) for t, *r in rows] + [(2 * i + 41, *r) for i, (_, *r) in enumerate(bad)]
    clean = [(t * 2, *r) for t, *r in rows] * 2  # copies of whole rows count once
    spec = J.JOBS["inverter"]

    def table(data):
        df = spark.createDataFrame(data, SC.INVERTER_RAW)
        out = J.training_table(spec, df, order=["time"])
        return sorted(tuple(r) for r in out.select("time", *spec.features, *spec.targets).collect())
    assert table(dirty) == table(clean) and len(table(dirty)) == 10
    assert table(dirty)[0][:2] == (40, 1.0)
    assert table([]) == []


def test_belt_history_keeps_the_means_for_scoring(spark):
    spec = _small(J.JOBS["belt_fault"])
    raw = _history(spark, spec).withColumn("current", F.when(F.col("id" if "id" in _history(spark, spec).columns
                                                                   else "reading") != 7, F.col("current")))
    table = J.training_table(spec, raw, keys=["machine"], order=["reading"])
    got = {r.reading: r.current_std for r in table.select("reading", "current_std").collect()}
    # by hand: sample deviation of up to five currents of the machine
    by = {}
    for r in raw.orderBy("reading").collect():
        by.setdefault(r.machine, []).append(r.current)
        last = [x for x in by[r.machine][-5:] if x is not None]
        if len(last) < 2:
            assert got[r.reading] is None
        else:
            m = sum(last) / len(last)
            assert got[r.reading] == pytest.approx((sum((x - m) ** 2 for x in last) / (len(last) - 1)) ** 0.5)
    job = J.train(spec, table, key=["reading"])
    fill = job.models["label"].stages[0].surrogateDF.first()
    train_rows = [r for r in J.S.split_flag(J.prepare(spec, table), ["reading"], 0.2).filter("not is_test").collect()]
    known = [r.current_std for r in train_rows if r.current_std is not None]
    assert fill["current_std"] == pytest.approx(sum(known) / len(known))
    # readings with head and tail speeds, and with nothing known but them, are scored
    new = spark.createDataFrame([(None, 2.0, 1.5, None, None, None)],
                                "current double, speed_head double, speed_tail double, vibration_motor double, "
                                "temperature_bearing double, current_std double")
    r = J.score(job, new).first()
    assert r.speed_diff == 0.5 and r.status is not None
    assert not [c for c in J.score(job, new).columns if c.startswith("_")]
