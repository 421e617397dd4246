"""Steps whose cost must follow the rows: training tables, counted windows, buffers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import models as ML
from plantpulse.operators import split as S
from plantpulse.operators import windows as W
from plantpulse.plans import learning
from plantpulse.streaming.stateful import frame_range, frame_stats
from tests.conftest import SF_SMALL


def test_training_partitions_follow_the_rows(spark, monkeypatch):
    df = spark.range(400)
    assert ML.spread(df).rdd.getNumPartitions() == ML.TRAIN_PARTITIONS
    monkeypatch.setattr(ML, "TRAIN_ROWS", 10)
    assert ML.spread(df).rdd.getNumPartitions() == 40


def test_a_large_training_table_is_sorted_inside_its_partitions(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") * 37 % 400).alias("x"), "id")
    pipe = ML.pipeline(["x"], ML.forest_classifier(2, 2, 1))

    def dealt():
        return [[r.x for r in part] for part in ML.training_table(pipe, df).rdd.glom().collect()]
    small = dealt()
    assert small == [[r.x for r in part] for part in df.repartition(ML.TRAIN_PARTITIONS).rdd.glom().collect()]
    monkeypatch.setattr(ML, "TRAIN_ROWS", 10)
    large = dealt()
    assert len(large) == 40 and sorted(sum(large, [])) == list(range(400))
    assert all(part == sorted(part) for part in large)


def test_boosting_deals_a_middling_table_to_more_partitions(spark, monkeypatch):
    assert [ML.train_partitions(n, True) for n in (0, 1_900_000, 2_900_000, 50_000_000)] == [16, 16, 24, 200]
    assert ML.train_partitions(2_900_000) == 16
    monkeypatch.setattr(ML, "BOOST_ROWS", 20)
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    for model, parts in ((ML.boosted_regressor(2), 20), (ML.boosted_one_vs_rest(2), 20), (ML.forest_regressor(2), 16)):
        assert ML.training_table(ML.pipeline(["x"], model), df).rdd.getNumPartitions() == parts


def test_forests_keep_no_node_id_per_row_and_tree(spark):
    assert not ML.forest_classifier().getCacheNodeIds() and not ML.forest_regressor().getCacheNodeIds()


def test_gapped_windows_of_small_devices_are_counted_once(spark, monkeypatch):
    rows = [(i % 4 or None, i if i < 60 else i + 500, i, float(i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "dev int, s long, id long, v double").withColumn("ts", F.timestamp_seconds("s"))

    def features(chunk_rows):
        out = W.lagged_window_features(df, ["dev"], ["ts", "id"], ripple="v", temperature="v", load="v", size=5,
                                       include_current=True, max_gap=100.0, chunk_rows=chunk_rows)
        return sorted(tuple(r) for r in out.drop("dev", "ts").collect()), out.count()
    plain, counted = W.with_chunks, []
    monkeypatch.setattr(W, "with_chunks", lambda *a, **k: counted.append(k["chunk_rows"]) or plain(*a, **k))
    whole = features(1000)
    assert whole[1] == 200 and set(counted) == {None}
    assert features(7) == whole and 7 in counted


def test_inverter_windows_are_computed_once_for_both_targets(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(pipe, train):
        raise Seen(train.inputFiles())
    monkeypatch.setattr(learning, "_MODELS", {})
    monkeypatch.setattr(learning.ML, "fit", fit)
    with pytest.raises(Seen) as seen:
        learning.inverter_two_output_forest(spark, SF_SMALL)
    assert seen.value.args[0] and all("inverter-windows" in f for f in seen.value.args[0])


def test_frames_from_a_row_on_and_of_several_columns():
    rng = np.random.default_rng(0)
    for n, size, start in ((1, 5, 0), (30, 20, 19), (12, 5, 3), (60, 20, 0)):
        x = rng.normal(size=n)
        one, two = frame_stats(x, size), frame_stats(np.stack([x + 1, x]), size, start)
        assert np.array_equal(one[0][start:], two[0])
        assert all(np.array_equal(a[start:], b[1]) for a, b in zip(one[1:], two[1:]))
        x[rng.random(n) < 0.2] = np.nan
        x[rng.random(n) < 0.1] = np.inf
        r = pd.Series(x).rolling(size, min_periods=1)
        assert np.array_equal(frame_range(x, size, start), (r.max() - r.min()).to_numpy()[start:], equal_nan=True)


def test_one_cut_of_all_rows_joins_nothing(spark):
    df = spark.range(50)
    out = S.exact_split_flag(df, ["id"], 0.2)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("is_test").count() == 10 and S.exact_split_flag(df.limit(0), ["id"], 0.2).count() == 0
