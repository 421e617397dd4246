"""Forests over binned rows against MLlib's learner on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import forests as FO
from plantpulse.operators import models as ML
from plantpulse.sources.sinks import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(6000).select(
        "id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        (F.col("id") * 37 % 29).cast("double").alias("c"))
    odd = F.col("id") * 7919 % 101 < 5
    label = F.when((F.col("a") > 9) & (F.col("b") > 2) | (F.col("c") < 4), 1.0).otherwise(0.0)
    return d.withColumns({"label": F.when(odd, 1 - label).otherwise(label), "weight": 1 + F.col("b") / 4,
                          "y": F.col("a") * 3 - F.col("b") * F.col("c") + 100}).cache()


def _fits(monkeypatch, pipe, rows):
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)
    monkeypatch.setattr(FO, "LARGE_ROWS", 0)
    here = ML.fit(pipe(), rows)
    monkeypatch.setattr(FO, "LARGE_ROWS", 10**12)
    return here, ML.fit(pipe(), rows)


PIPES = {
    "classes": lambda trees, depth: ML.pipeline(["a", "b", "c"], ML.forest_classifier(trees, depth, 1, subset="all")),
    "weights": lambda trees, depth: ML.pipeline(["a", "b", "c"], ML.forest_classifier(
        trees, depth, 1, subset="all", weight_col="weight")),
    "numbers": lambda trees, depth: ML.pipeline(["a", "b", "c"], ML.forest_regressor(trees, depth, 1, subset="all"), label="y"),
    "leaves": lambda trees, depth: ML.pipeline(["a", "b", "c"], ML.forest_regressor(
        trees, depth, 1, subset="all").setMinInstancesPerNode(40), label="y"),
}


@pytest.mark.parametrize("kind, depth", [("classes", 5), ("classes", 0), ("weights", 5), ("leaves", 5)])
def test_a_tree_of_all_rows_is_mllibs_tree(spark, rows, monkeypatch, kind, depth):
    def pipe():
        p = PIPES[kind](1, depth)
        p.getStages()[-1].setBootstrap(False)
        return p
    here, there = _fits(monkeypatch, pipe, rows)
    out = [sorted((r.id, r.prediction, *(r.probs if "probs" in r else ())) for r in ML.scored(m, rows).collect())
           for m in (here, there)]
    assert np.allclose(out[0], out[1], atol=1e-9)
    a, b = here.stages[-1], there.stages[-1]
    assert type(a) is type(b) and a.totalNumNodes == b.totalNumNodes and a.numFeatures == 3
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)


@pytest.mark.parametrize("kind", ["classes", "numbers"])
def test_a_forest_is_as_good_as_mllibs(spark, rows, monkeypatch, tmp_path, kind):
    def pipe():
        p = PIPES[kind](20, 6)
        p.getStages()[-1].setFeatureSubsetStrategy("sqrt")
        return p
    here, there = _fits(monkeypatch, pipe, rows)
    label = "label" if kind == "classes" else "y"

    def error(m):
        return ML.scored(m, rows).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
    assert error(here) <= error(there) * 1.1 + 0.01
    assert here.stages[-1].getNumTrees == 20 and len({t.numNodes for t in here.stages[-1].trees}) > 1
    save_model(here, f"{tmp_path}/m")
    again = load_model(f"{tmp_path}/m")
    assert ML.scored(here, rows).select("id", "prediction").exceptAll(
        ML.scored(again, rows).select("id", "prediction")).count() == 0


def test_bags_follow_from_seed_tree_and_block():
    n = 200_001
    a = FO.bag_counts(42, 3, 5 << 24, n)
    assert np.array_equal(a, FO.bag_counts(42, 3, 5 << 24, n)) and len(a) == n
    assert not np.array_equal(a, FO.bag_counts(42, 4, 5 << 24, n)) and not np.array_equal(a, FO.bag_counts(42, 3, 6 << 24, n))
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.03


def test_fits_do_not_depend_on_how_blocks_are_dealt(spark, rows, monkeypatch):
    monkeypatch.setattr(FO, "LARGE_ROWS", 0)
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)
    pipe = lambda: ML.pipeline(["a", "b", "c"], ML.forest_classifier(5, 5, 1))
    whole = [t.toDebugString for t in ML.fit(pipe(), rows).stages[-1].trees]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        cut = [t.toDebugString for t in ML.fit(pipe(), rows).stages[-1].trees]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [t.split("\n", 1)[1] for t in whole] == [t.split("\n", 1)[1] for t in cut]


def test_odd_rows_and_settings_are_left_to_mllib(spark, rows, monkeypatch):
    monkeypatch.setattr(FO, "LARGE_ROWS", 0)
    assert not FO.takes(ML.forest_classifier(5, 30)) and not FO.takes(ML.boosted_regressor(2))
    bad = rows.withColumn("label", F.when(F.col("id") != 7, F.col("label")))
    with pytest.raises(Exception, match="(?i)label"):
        ML.fit(PIPES["classes"](2, 2), bad)
    one = ML.fit(PIPES["classes"](3, 3), rows.withColumn("label", F.lit(0.0)))
    assert {r.prediction for r in ML.scored(one, rows).collect()} == {0.0}
