"""Models made of models: targets, votes, the life search, the registry."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plantpulse.operators import ensembles as EN
from plantpulse.operators import models as ML
from plantpulse.plans.learning import FOREST_GRID, life_search
from plantpulse.sources.model_registry import ModelRegistry


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(400).select(
        "id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    return d.withColumns({"label": (F.col("a") > 9).cast("double"), "life": 100 - F.col("a"),
                          "heat": (F.col("b") > 3).cast("double"), "fold": (F.col("id") % 5).cast("int")}).cache()


@pytest.fixture(scope="module")
def members(rows):
    return [ML.fit(ML.pipeline(["a", "b"], ML.forest_classifier(5, 3, 1)), rows),
            ML.fit(ML.pipeline(["a", "b"], ML.logistic(5)), rows)]


def _probs(df):
    return {r.id: (tuple(r.probs), r.prediction, r.confidence) for r in df.collect()}


def test_vote_equals_the_join_of_the_members(rows, members):
    got = _probs(EN.VotingModel(members).transform(rows))
    want = _probs(ML.soft_vote([ML.scored(m, rows) for m in members], ["id"], "label"))
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][0] == pytest.approx(want[i][0], abs=1e-12) and got[i][1] == want[i][1]


def test_vote_keeps_rows_and_columns_and_shuffles_nothing(rows, members):
    clash = rows.select("*", F.lit("x").alias("probability of rain"), F.lit(1).alias("member"))
    out = EN.VotingModel(members).transform(clash)
    assert out.columns == [*clash.columns, "probs", "prediction", "confidence"] and out.count() == 400
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert EN.VotingModel(members).transform(rows.limit(0)).count() == 0


def test_vote_weights_and_ties(rows, members):
    one = _probs(EN.VotingModel(members, [1.0, 0.0]).transform(rows))
    alone = _probs(ML.scored(members[0], rows))
    assert all(one[i][0] == pytest.approx(alone[i][0]) for i in one)
    with pytest.raises(ValueError):
        EN.VotingModel(members, [0.0, 0.0])
    with pytest.raises(ValueError):
        EN.VotingModel(members, [1.0])


def test_vote_is_saved_and_loaded_as_a_stage(rows, members, tmp_path):
    stage = EN.VotingModel(members, [2.0, 1.0])
    PipelineModel([stage]).write().overwrite().save(f"{tmp_path}/vote")
    loaded = PipelineModel.load(f"{tmp_path}/vote")
    assert loaded.stages[0].weights == [2.0, 1.0]
    assert _probs(loaded.transform(rows)) == _probs(stage.transform(rows))


def test_one_model_per_target(rows, tmp_path):
    rf = ML.forest_regressor(5, 6, 1, subset="all").setFeaturesCol("_raw")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_raw"),
                            EN.MultiTarget(rf, ["life", "heat"])])
    some = rows.withColumn("heat", F.when(F.col("id") % 3 > 0, F.col("heat")))  # unknown for a third
    model = pipe.fit(some)
    out = model.transform(rows)
    assert set(out.columns) == {*rows.columns, "_raw", "pred_life", "pred_heat"} and out.count() == 400
    assert EN.TargetMAE("life").evaluate(out) < 1.5 and EN.TargetMAE("heat").evaluate(out) < 0.2
    model.write().overwrite().save(f"{tmp_path}/two")
    again = PipelineModel.load(f"{tmp_path}/two").transform(rows)
    assert out.exceptAll(again.select(out.columns)).count() == 0


def test_life_error_equals_sql(spark):
    d = spark.createDataFrame([(90.0, 80.0), (50.0, 55.5), (None, 1.0), (70.0, None)], "life double, pred_life double")
    d.createOrReplaceTempView("life_errors")
    want = spark.sql("SELECT avg(abs(life - pred_life)) FROM life_errors").first()[0]
    e = EN.TargetMAE("life")
    assert e.evaluate(d) == want == 7.75 and not e.isLargerBetter()
    assert math.isnan(e.evaluate(d.limit(0)))


def test_life_search_sets_the_parameters_of_all_targets(rows):
    cvm, res = life_search(rows, ["a", "b"], ["life", "heat"], "life", {"numTrees": [3], "maxDepth": [1, 6]})
    got = {r.params: r for r in res.collect()}
    shallow, deep = got["maxDepth=1, numTrees=3"], got["maxDepth=6, numTrees=3"]
    assert deep.best and not shallow.best and deep.metric < shallow.metric
    best = cvm.bestModel.stages[-1]
    assert [m.getNumTrees for m in best.members] == [3, 3] and best.members[0].getMaxDepth() == 6
    # the errors of one fold by hand
    rf = ML.forest_regressor(3, 6, 42, subset="all").setFeaturesCol("_raw")
    folds = []
    for k in range(5):
        pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_raw"), EN.MultiTarget(rf, ["life"])])
        m = pipe.fit(rows.filter(F.col("fold") != k))
        folds.append(EN.TargetMAE("life").evaluate(m.transform(rows.filter(F.col("fold") == k))))
    assert deep.metric == pytest.approx(sum(folds) / 5, rel=0.5)


def test_life_search_fits_other_targets_for_the_best_point_only(rows, monkeypatch):
    fitted, fit = [], EN.MultiTarget._fit
    monkeypatch.setattr(EN.MultiTarget, "_fit", lambda self, df: (fitted.extend(self.targets), fit(self, df))[1])
    grid = {"numTrees": [3], "maxDepth": [2, 4]}
    cvm, res = life_search(rows, ["a", "b"], ["heat", "life"], "life", grid)
    assert sorted(fitted) == ["heat"] + ["life"] * 11  # 2 points x 5 folds, and the best point
    # the same errors and the same best model as with both targets in every fold
    rf = ML.forest_regressor(100, 10, 42, subset="all").setFeaturesCol("_raw")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_raw"), EN.MultiTarget(rf, ["heat", "life"])])
    want, all_res = ML.cross_validate(pipe, ML.param_grid(rf, **grid), EN.TargetMAE("life"), rows)
    assert res.orderBy("point").collect() == all_res.orderBy("point").collect()
    got, whole = cvm.bestModel.transform(rows), want.bestModel.transform(rows)
    assert cvm.bestModel.stages[-1].targets == ["heat", "life"] and got.columns == whole.columns
    assert got.exceptAll(whole).count() == 0


def test_search_grid_has_the_36_points():
    n = math.prod(len(v) for v in FOREST_GRID.values())
    assert n == 36 and FOREST_GRID["numTrees"] == [50, 100, 200]


def test_registry_gate(spark, rows, members, tmp_path):
    reg = ModelRegistry(spark, f"{tmp_path}/models")
    assert reg.current() is None
    with pytest.raises(ValueError):
        reg.load()
    scores = iter([0.8, 0.8, 0.7, 0.8, 0.8, 0.8, float("nan")])
    metric = lambda model: next(scores)
    assert reg.challenge(members[0], metric) == (None, 0.8, True)
    # the second run compares with the first one's model and loses
    assert reg.challenge(members[1], metric) == (0.8, 0.7, False) and reg.current()["version"] == 1
    assert reg.challenge(members[1], metric) == (0.8, 0.8, True) and reg.current()["version"] == 2
    assert reg.challenge(members[0], metric)[2] is False and reg.current()["version"] == 2
    assert _probs(ML.scored(reg.load(1), rows)) == _probs(ML.scored(members[0], rows))
    assert _probs(ML.scored(reg.load(), rows)) == _probs(ML.scored(members[1], rows))
    assert reg.rollback(1) == 3
    assert _probs(ML.scored(ModelRegistry(spark, reg.path).load(), rows)) == _probs(ML.scored(members[0], rows))


def test_registry_refuses_a_number_that_is_taken(spark, members, tmp_path):
    reg = ModelRegistry(spark, f"{tmp_path}/models")
    reg.publish(members[0], 0.5)
    with pytest.raises(RuntimeError):
        reg.manifests.commit({"version": 1, "model": "elsewhere", "metric": 1.0})
    assert reg.current()["metric"] == 0.5
