"""Distributed model fitting and scoring with MLlib.

Pipelines assemble named columns late (``VectorAssembler``; the column list
is the feature contract), optionally scale, expand and then fit a forest /
boosted trees / linear model. Training tables are persisted MEMORY_AND_DISK
for the duration of a fit only (tree learners pass over the data once per
level). Closed-form per-device regressions use native ``regr_*``
aggregates instead of one model per device.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forests

# More tree nodes split per pass over the data (fewer passes for 100-tree
# forests). Trees are walked again at each level: cached node ids are one number
# per row and tree, kept for several levels and checkpointed besides.
TREE_TUNING = {"maxMemoryInMB": 1024, "cacheNodeIds": False}
BOOST_TUNING = {"maxMemoryInMB": 1024}


def pipeline(features: Sequence[str], model, *, scale: bool = True, poly_degree: int | None = None,
             label: str = "label", impute: bool = False) -> Pipeline:
    """(mean fill) -> assembler -> (scaler) -> (polynomial expansion) ->
    model. ``impute`` (P14) keeps the training means in the fitted pipeline and
    fills missing features with them when it scores."""
    stages, inputs = [], list(features)
    if impute:
        inputs = [f"_fill_{f}" for f in features]
        stages.append(Imputer(strategy="mean", inputCols=list(features), outputCols=inputs))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="error"))
    cur = "_raw"
    if scale:
        stages.append(StandardScaler(inputCol=cur, outputCol="_scaled", withMean=True, withStd=True))
        cur = "_scaled"
    if poly_degree:
        stages.append(PolynomialExpansion(inputCol=cur, outputCol="_poly", degree=poly_degree))
        cur = "_poly"
    model.setFeaturesCol(cur).setLabelCol(label)
    stages.append(model)
    return Pipeline(stages=stages)


def forest_classifier(trees: int = 100, depth: int = 10, seed: int = 42, *,
                      subset: str = "sqrt", weight_col: str | None = None) -> RandomForestClassifier:
    """M5 (``max_depth=None`` in the reference -> MLlib's cap of 30; default 10)."""
    m = RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), seed=seed,
                               featureSubsetStrategy=subset, **TREE_TUNING)
    if weight_col:
        m.setWeightCol(weight_col)
    return m


def forest_regressor(trees: int = 100, depth: int = 10, seed: int = 42, *,
                     subset: str = "sqrt") -> RandomForestRegressor:
    """M6: ``subset='sqrt'`` (IGBT) or ``'all'`` (inverter)."""
    return RandomForestRegressor(numTrees=trees, maxDepth=min(depth, 30), seed=seed,
                                 featureSubsetStrategy=subset, **TREE_TUNING)


def boosted_regressor(iters: int = 200, depth: int = 5, step: float = 0.1,
                      min_leaf: int = 5, seed: int = 42) -> GBTRegressor:
    """M8 (min samples split has no MLlib counterpart)."""
    return GBTRegressor(maxIter=iters, maxDepth=depth, stepSize=step,
                        minInstancesPerNode=min_leaf, seed=seed, **BOOST_TUNING)


def linear_regressor() -> LinearRegression:
    """M9: ordinary least squares with intercept."""
    return LinearRegression(regParam=0.0, elasticNetParam=0.0, fitIntercept=True)


def boosted_one_vs_rest(iters: int = 50, depth: int = 5, seed: int = 42) -> OneVsRest:
    """Gradient boosting for multi-class (MLlib GBT is binary)."""
    return OneVsRest(classifier=GBTClassifier(maxIter=iters, maxDepth=depth, seed=seed, **BOOST_TUNING))


def logistic(max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter)


#: Partitions of a training table of up to ``TRAIN_ROWS`` rows each; a larger
#: table gets more. The number follows from the rows alone, so that bagging and
#: the fitted trees do not depend on the cluster.
TRAIN_PARTITIONS = 16
TRAIN_ROWS = 250_000

#: Boosting passes over the rows once per round and level, so that a pass should
#: end on all cores at once: smaller partitions, as long as they are few (each
#: writes the statistics of its nodes in every pass).
BOOST_PARTITIONS = 24
BOOST_ROWS = 120_000


def train_partitions(rows: int, boosted: bool = False) -> int:
    """Partitions of a training table."""
    fine = min(BOOST_PARTITIONS, -(-rows // BOOST_ROWS)) if boosted else 0
    return max(TRAIN_PARTITIONS, fine, -(-rows // TRAIN_ROWS))


def spread(df: DataFrame, partitions: int | None = None, *, by: Sequence[str] = (), boosted: bool = False) -> DataFrame:
    """Deal a training table to a number of partitions that follows from its
    rows: tree learners run one task per partition on every pass and keep a
    number per row and tree. A table of more than ``TRAIN_PARTITIONS`` of them is
    sorted by ``by`` inside each: neighbours then go down the same nodes."""
    if partitions is not None:
        return df.repartition(partitions)
    rows = df.count()
    dealt = df.repartition(train_partitions(rows, boosted))
    return dealt.sortWithinPartitions(*by) if by and rows > TRAIN_PARTITIONS * TRAIN_ROWS else dealt


def training_table(pipe: Pipeline, train: DataFrame) -> DataFrame:
    """The table spread for a pipeline's learner, sorted by its inputs if large."""
    stages = pipe.getStages()
    inputs = [c for s in stages if isinstance(s, VectorAssembler) for c in s.getInputCols() if c in train.columns]
    return spread(train, by=inputs, boosted=isinstance(stages[-1], (GBTClassifier, GBTRegressor, OneVsRest)))


def fit(pipe: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit with the training table spread over the cluster and persisted only
    for the duration of the fit. Forests of large tables are fitted over binned
    rows (``forests``)."""
    t = training_table(pipe, train).persist(StorageLevel.MEMORY_AND_DISK)
    *before, learner = pipe.getStages()
    try:
        if not forests.takes(learner) or t.count() <= forests.LARGE_ROWS:
            return pipe.fit(t)
        ready = Pipeline(stages=before).fit(t)
        return PipelineModel([*ready.stages, forests.fit_forest(learner, ready.transform(t))])
    finally:
        t.unpersist()


def scored(model: PipelineModel, df: DataFrame, *, classes: Sequence[str] | None = None) -> DataFrame:
    """Batch (or streaming) scoring; probabilities as ``array<double>``
    plus the arg-max confidence (O2) and, with ``classes``, the class name."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
        out = out.withColumn("confidence", F.array_max("probs"))
        if classes:
            names = F.array(*[F.lit(c) for c in classes])
            out = out.withColumn("predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1))
    drop = [c for c in out.columns if c in ("_raw", "_scaled", "_poly", "rawPrediction", "probability")
            or c.startswith("_fill_")]
    return out.drop(*drop)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Impurity importances as rows, highest first (one row per
    feature -- bounded by the feature contract)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                               "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def cross_validate(pipe: Pipeline, grid, evaluator, train: DataFrame, *, fold_col: str = "fold",
                   num_folds: int = 5, parallelism: int = 4, finish=None, measure=None):
    """K-fold CV over a parameter grid with a deterministic fold
    column; returns (CrossValidatorModel, grid-results DataFrame with the best
    point flagged, O4). ``finish`` makes the best model, from the one that the
    search fitted, the training table and the best point's parameters. ``measure``
    gives the metrics of all folds and points from the training table, where a
    learner has them for less than a fit each; None leaves them to the fits."""
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=evaluator,
                        foldCol=fold_col, numFolds=num_folds, parallelism=parallelism, seed=42)
    t = training_table(pipe, train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = measure(t, fold_col, num_folds) if measure is not None else None
        cvm = cv.fit(t) if found is None else CrossValidatorModel(
            None, found.mean(axis=0).tolist(), None, found.std(axis=0).tolist())
        pick = max if evaluator.isLargerBetter() else min
        best = pick(range(len(grid)), key=lambda i: cvm.avgMetrics[i])
        if found is not None:
            cvm.bestModel = pipe.fit(t, grid[best])
        if finish is not None:
            cvm.bestModel = finish(cvm.bestModel, t, grid[best])
    finally:
        t.unpersist()
    rows = []
    for i, (pm, m) in enumerate(zip(grid, cvm.avgMetrics)):
        desc = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        rows.append((i, desc, float(m), float(cvm.stdMetrics[i]) if cvm.stdMetrics else None))
    spark = train.sparkSession
    res = spark.createDataFrame(rows, "point int, params string, metric double, metric_std double")
    return cvm, res.withColumn("best", F.col("point") == best)


def soft_vote(scored_tables: Sequence[DataFrame], key: Sequence[str], label: str) -> DataFrame:
    """Join member scorings on the key, average the probability arrays,
    predict the arg-max class."""
    base = scored_tables[0].select(*key, label, F.col("probs").alias("_p0"))
    for i, t in enumerate(scored_tables[1:], start=1):
        base = base.join(t.select(*key, F.col("probs").alias(f"_p{i}")), list(key))
    n = len(scored_tables)
    avg = F.col("_p0")
    for i in range(1, n):
        avg = F.zip_with(avg, F.col(f"_p{i}"), lambda a, b: a + b)
    avg = F.transform(avg, lambda x: x / n)
    out = base.withColumn("probs", avg)
    return (out.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("double"))
               .withColumn("confidence", F.array_max("probs"))
               .drop(*[f"_p{i}" for i in range(n)]))


def grouped_linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """M18 / M9 (one feature): closed-form OLS per device with native
    aggregates -- one partial aggregation, any number of devices."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def vectors_from_array(col: str) -> F.Column:
    """``array<float>`` embedding -> ML vector."""
    return array_to_vector(F.col(col))


def weighted_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="f1")


def r2_evaluator() -> RegressionEvaluator:
    return RegressionEvaluator(metricName="r2")


def param_grid(model, **params) -> list:
    b = ParamGridBuilder()
    for name, values in params.items():
        b = b.addGrid(getattr(model, name), list(values))
    return b.build()
