"""Exact splits and folds (M1, M2, M11, W10), look-ahead with a tolerance (W8),
alignment of signals (J3)."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import joins as J
from plantpulse.operators import split as S

SIZES = {"a": 1003, "b": 5, "c": 2, "d": 1, None: 37}


def rows_of(spark):
    data = [(i * 7 + j, c) for j, (c, n) in enumerate(SIZES.items()) for i in range(n)]
    return spark.createDataFrame(data, "id long, cls string")


@pytest.mark.parametrize("digits", [1, 4])
def test_every_class_has_its_exact_share(spark, monkeypatch, digits):
    monkeypatch.setattr(S, "CUT_DIGITS", digits)
    df = rows_of(spark).withColumn("_pp_b", F.lit(1))
    got = Counter((r.cls, r.is_test) for r in S.exact_split_flag(df.drop("_pp_b"), ["id"], 0.2, "cls").collect())
    assert {c: got[c, True] for c in SIZES} == {c: math.ceil(n / 5) if n > 1 else 0 for c, n in SIZES.items()}
    assert {c: got[c, True] + got[c, False] for c in SIZES} == SIZES
    whole = S.exact_split_flag(df, ["id"], 0.2).where("is_test").count()
    ids = sorted((hashlib.md5(str(r.id).encode()).hexdigest(), str(r.id)) for r in df.collect())
    cut = math.ceil(len(ids) / 5)
    assert whole == sum(x <= ids[cut - 1] for x in ids) >= cut


def test_folds_differ_by_one_row_at_most(spark):
    got = Counter((r.cls, r.fold) for r in S.exact_fold_id(rows_of(spark), ["id"], 5, "cls").collect())
    for c, n in SIZES.items():
        assert all(got[c, k] in (n // 5, n // 5 + 1) for k in range(5)), c


def test_split_of_nothing_and_of_repeated_keys(spark):
    df = rows_of(spark)
    assert S.exact_split_flag(df.limit(0), ["id"], 0.2, "cls").count() == 0
    twice = S.exact_split_flag(df.union(df), ["id"], 0.2, "cls")
    assert twice.groupBy("id", "cls").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("how", [{"chunk_rows": None}, {"chunk_rows": 7}, {"chunk_seconds": 50}])
def test_look_ahead_within_a_tolerance(spark, how):
    rng = np.random.default_rng(3)
    rows = [([None, 1, 2][rng.integers(3)], int(rng.integers(0, 900)), i, float(i)) for i in range(150)] + [(1, None, 999, 9.0), (1, 5000, 998, 8.0)]
    df = spark.createDataFrame(rows, "dev int, s long, id long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.next_v for r in J.asof_forward_value(df, ["dev"], "ts", "id", ["v"], 60.0, tolerance_seconds=20.0, **how).collect()}
    want = {}
    for d, s, i, _ in rows:
        later = sorted((t, j, v) for e, t, j, v in rows if e == d and s is not None and t is not None and t > s + 60)
        want[i] = later[0][2] if later and later[0][0] <= s + 80 else None
    assert got == want and None in got.values() and sum(v is not None for v in got.values()) > 50


def test_alignment_keeps_one_sided_buckets(spark):
    rows = [(1, 10, "fast", 1.0), (1, 20, "fast", 3.0), (1, 70, "slow", 5.0), (1, 130, "fast", 7.0), (None, 10, "slow", 2.0), (1, 15, "other", 9.0)]
    df = spark.createDataFrame(rows, "dev int, s long, kind string, v double").withColumn("ts", F.timestamp_seconds("s"))
    out = J.align_signals(df, ["dev"], "ts", "kind", "v", {"fast": "fast", "slow": "slow"}, period="1 minute", carry=["slow"])
    got = {(r.dev, int(r.bucket.timestamp())): (r.fast, r.slow) for r in out.collect()}
    assert got == {(1, 0): (2.0, None), (1, 60): (None, 5.0), (1, 120): (7.0, 5.0), (None, 0): (None, 2.0)}
