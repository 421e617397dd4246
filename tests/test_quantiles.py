"""Exact quantiles and band power without one task per group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import profile as A
from plantpulse.operators.quantiles import counted_ranges, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_quantiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 400)] + [("b", float(v)) for v in rng.normal(size=57)]
    rows += [("one", 4.0), (None, 1.5), (None, -1.5), ("none", None), ("a", None), ("a", 0.0), ("a", -0.0)]
    df = spark.createDataFrame(rows, "cls string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.cls: list(r.q) for r in exact_quantiles(df, ["cls"], "v", PROBS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == {"a", "b", "one", None}
    for c, q in got.items():
        assert q == pytest.approx(np.quantile([v for k, v in rows if k == c and v is not None], PROBS), abs=1e-12)


def test_quantiles_of_a_million_distinct_values(spark):
    """One class holds all rows; its values are spread over many ranges."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("cls"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 4).alias("v"))
    largest = counted_ranges(df, ["cls"], "v").groupBy("_pp_pid").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert largest[0] < n / 2 and largest[1] >= 3
    q = exact_quantiles(df, ["cls"], "v", [0.25, 0.5, 0.75]).first().q
    assert q == pytest.approx(np.quantile(np.arange(n) / 4, [0.25, 0.5, 0.75]), abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "cls string, v double")
    assert exact_quantiles(df, ["cls"], "v", [0.5]).count() == 0
    assert A.describe(df, ["v"]).first()["p50"] is None and A.box_stats(df, "cls", ["v"]).count() == 0


def test_no_percentile_over_raw_values(spark, monkeypatch):
    def never(*_):
        raise AssertionError("percentile holds a group in one task")
    for name in ("percentile", "median"):
        monkeypatch.setattr(F, name, never)
    df = spark.range(100).select((F.col("id") % 3).alias("cls"), F.col("id").cast("double").alias("v"))
    assert A.describe(df, ["v"]).count() == 1 and A.box_stats(df, "cls", ["v"]).count() == 3


def test_box_stats_keep_a_null_class(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("x", 1.0), (None, 99.0)], "cls string, v double")
    got = {r.cls: r for r in A.box_stats(df, "cls", ["v"]).collect()}
    assert got[None].median == 4.5 and got[None].n_outliers == 1 and got[None].whisker_hi == 8.0 and got["x"].q1 == 1.0


@pytest.mark.parametrize("how", [{"chunk_rows": 20}, {"chunk_seconds": 3600}])
def test_band_power_of_chunks_equals_plain(spark, how):
    df = spark.range(600).select(
        F.when(F.col("id") % 5 > 0, F.lit(1)).alias("dev"), F.col("id"), (F.sin("id") * 3).alias("v"),
        F.timestamp_seconds(F.col("id") * 431 % 172_800).alias("ts"))

    def rows(**kw):
        out = A.band_power(df, ["dev"], ["ts", "id"], "v", **kw).collect()
        return sorted((r.dev or 0, r.period_start, r.n, *(round(r[f"power_{k}"], 6) for k in (1, 2, 3))) for r in out)
    plain = rows(chunk_rows=None)
    assert len(plain) == 4 and rows(**how) == plain
    day = [r for r in df.collect() if r.dev == 1 and r.ts.timestamp() < 86_400]
    v = np.array([r.v for r in sorted(day, key=lambda r: (r.ts, r.id))])
    want = np.abs(np.fft.fft(v))[1:4] ** 2
    assert plain[2][3:] == pytest.approx(want, rel=1e-6)
