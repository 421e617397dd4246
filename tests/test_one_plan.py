"""Keys and clocks that used to change the plan or the answer: NULL devices,
one global key, keys above 2**53, an outlying clock, labels outside a list."""

import math

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import metrics as M
from plantpulse.operators import quality as Q
from plantpulse.operators.alerts import cooldown_fired
from plantpulse.operators.profile import prediction_distribution
from plantpulse.operators.windows import _C, forward_fill, rolling_std, with_chunks


def events(spark, rows):
    return spark.createDataFrame(rows, "dev long, id long, s long").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("chunk_rows", [None, 2])
def test_cooldown_of_null_big_and_global_keys(spark, chunk_rows):
    big = 2**53
    rows = [(None, i, t) for i, t in enumerate([0, 100, 200, 700])]
    rows += [(big, 10, 0), (big + 1, 11, 5), (big, 12, 30), (big + 1, 13, 700)]
    df = events(spark, rows)
    fired = sorted(r.id for r in cooldown_fired(df, ["dev"], "ts", "id", 600, chunk_rows=chunk_rows).collect())
    assert fired == [0, 3, 10, 11, 13]
    alone = sorted(r.id for r in cooldown_fired(df, [], "ts", "id", 600, chunk_rows=chunk_rows).collect())
    assert alone == [0, 3]  # 13 has the same time as 3 and the later id
    assert cooldown_fired(df.limit(0), ["dev"], "ts", "id", 600).count() == 0


def test_outlying_clock_makes_no_large_chunk(spark):
    n, most = 5000, 100
    df = events(spark, [(1, 0, 0)] + [(1, i, 1_700_000_000 + i) for i in range(1, n + 1)])
    widest = with_chunks(df, ["dev"], "ts", chunk_rows=most).groupBy(_C).count().agg(F.max("count")).first()[0]
    assert widest <= 2 * most


def test_null_device_keeps_its_carry(spark):
    df = events(spark, [(None, i, i) for i in range(9)]).withColumn("v", F.when(F.col("id") == 0, 1.0))
    for how in ({"chunk_rows": None}, {"chunk_rows": 2}, {"chunk_seconds": 3}):
        got = [r.v for r in forward_fill(df, ["dev"], ["ts", "id"], ["v"], **how).orderBy("id").collect()]
        assert got == [1.0] * 9


def test_history_longer_than_the_frame(spark):
    df = events(spark, [(1, i, i) for i in range(8)]).withColumn("v", F.col("id") * 1.0)
    got = [r.x for r in rolling_std(df, ["dev"], ["ts", "id"], "v", "x", size=5, ddof=0, min_n=6).orderBy("id").collect()]
    assert got[:5] == [0.0] * 5 and all(x == pytest.approx(math.sqrt(2)) for x in got[5:])


def test_labels_outside_the_list_count(spark):
    df = spark.createDataFrame([("a", "a"), ("z", "a"), ("a", "y")], "label string, pred string")
    cells = {(r.label, r.pred): r.n for r in M.confusion_long(df, "label", "pred", ["a", "b"]).collect()}
    assert sum(cells.values()) == 3 and cells["b", "b"] == 0 and cells["z", "a"] == 1
    rep = {r["row"]: r for r in M.classification_report(df, "label", "pred", ["a", "b"]).collect()}
    assert rep["accuracy"].support == 3 and rep["accuracy"].precision == pytest.approx(1 / 3) and rep["z"].recall == 0
    dist = {r.pred: r.n for r in prediction_distribution(df, "pred", ["a", "b"]).collect()}
    assert dist == {"a": 2, "b": 0, "y": 1}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "y"), (None, "z"), (2.0, None)], "v double, s string")
    for rule, want in ((Q.not_null("v", "s"), 1), (Q.positive("v"), 2), (Q.in_range("v", lo=0.0), 2)):
        assert df.where(rule.passes).count() == want
