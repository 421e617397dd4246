"""Profiles and chart data.

All are aggregations with map-side partial aggregation. Exact quantiles
(``exact=True``) are selected over ranges of values (``quantiles``), so no task
holds a group however many distinct values it has; ``exact=False`` uses
``percentile_approx``, which needs no shuffle of the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_small, null_safe_join
from .quantiles import exact_quantiles
from .windows import DEFAULT_CHUNK_ROWS, running_count

QUARTILES = [0.25, 0.5, 0.75]


def _quantiles(long: DataFrame, keys: Sequence[str], value: str, exact: bool, accuracy: int) -> DataFrame:
    """(keys, q): the quartiles of ``value`` per group."""
    if exact:
        return exact_quantiles(long, keys, value, QUARTILES)
    arr = F.array(*[F.lit(p) for p in QUARTILES])
    return long.groupBy(*keys).agg(F.percentile_approx(value, arr, accuracy).alias("q"))


def describe(df: DataFrame, cols: Sequence[str], *, exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """A1: count, mean, sample std, min, 25/50/75 % (linear), max per column,
    one row per column. The moments are one aggregation over the wide rows, the
    quartiles are selected over (column, value)."""
    one = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in cols]).alias("s"))
    q = _quantiles(long_format(df, [], cols, "column"), ["column"], "value", exact, accuracy)
    return (one.select(F.inline("s")).join(q, "column", "left")
               .select("column", "count", "mean", "std", "min",
                       F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                       F.col("q")[2].alias("p75"), "max"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: pairwise Pearson correlation, all pairs in one aggregation,
    returned as ``(col_a, col_b, corr)`` (diagonal included)."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                    (F.lit(1.0) if a == b else F.corr(a, b)).alias("corr"))
                           for a, b in pairs]).alias("m"))
    return one.select(F.inline("m"))


def class_counts(df: DataFrame, cls: str, *, share_name: str = "share") -> DataFrame:
    """A3: count and share per class (the share window runs over the
    aggregated rows only: one per class)."""
    g = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn(share_name, F.col("n") / F.sum("n").over(Window.partitionBy()))


def prediction_distribution(df: DataFrame, pred: str, classes: Sequence[str]) -> DataFrame:
    """A4: count per predicted class, including listed classes never predicted
    and predicted classes outside the list."""
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(pred)).select(
        F.col(pred).cast(df.schema[pred].dataType), F.lit(0).cast("long").alias("n"))
    counts = df.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(listed).groupBy(pred).agg(F.sum("n").alias("n"))


def prediction_summary(df: DataFrame, col: str) -> DataFrame:
    """A5: mean / min / max of a prediction column."""
    return df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"),
                  F.count(col).alias("n"))


def histogram(df: DataFrame, value: str, cls: str | None = None, *, bins: int = 30) -> DataFrame:
    """Equal-width bins on each class's own min..max, last bin closed
    (numpy semantics; a constant class gets the range v-0.5..v+0.5, so all
    of it lands in the middle bin). Returns non-empty bins with edges."""
    keys = [cls] if cls else ["_pp_all"]
    src = df if cls else df.withColumn("_pp_all", F.lit(0))
    x = src.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rng = x.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rng = rng.select(*keys,
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"))
    # per-class ranges: one row per class, broadcast after a size check (a
    # shuffle join keyed by class would put a dominant class in one task)
    j = join_small(x, rng, keys, "left")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1)).cast("int")
    out = (j.withColumn("bin", b)
            .groupBy(*keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n"))
    return out if cls else out.drop("_pp_all")


def long_format(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                name: str = "feature", value: str = "value") -> DataFrame:
    """Stack feature columns into (ids..., feature, value) rows."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(list(ids), list(cols), name, value)


def box_stats(df: DataFrame, cls: str, cols: Sequence[str], *, exact: bool = True,
              accuracy: int = 10_000, whisker: float = 1.5) -> DataFrame:
    """Per class x feature q1 / median / q3 / mean, whiskers at the most
    extreme points within ``whisker * IQR``, and the outlier count."""
    long = long_format(df, [cls], cols).filter(F.col("value").isNotNull())
    q = null_safe_join(long.groupBy(cls, "feature").agg(F.avg("value").alias("mean")),
                       _quantiles(long, [cls, "feature"], "value", exact, accuracy), [cls, "feature"])
    q = q.select(cls, "feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"), "mean")
    fence_lo = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    fence_hi = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= fence_lo) & (F.col("value") <= fence_hi)
    w = null_safe_join(long, materialize(q, "quartiles"), [cls, "feature"]).groupBy(cls, "feature", "q1", "median", "q3", "mean").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
    return w


def threshold_count(df: DataFrame, col: str, threshold: float, name: str) -> DataFrame:
    """Rows above a threshold."""
    return df.agg(F.count_if(F.col(col) > threshold).alias(name))


def fault_frequency(df: DataFrame, device: str, ts: str, fault: Column, *,
                    period: str = "1 day") -> DataFrame:
    """Faults per device and period with device and grand totals
    (``rollup``); ``period_start`` NULL marks a device total, both NULL the
    grand total."""
    x = df.select(device, F.window(ts, period).start.alias("period_start"),
                  fault.cast("int").alias("_f"))
    return (x.rollup(device, "period_start")
             .agg(F.count(F.lit(1)).alias("n_readings"), F.sum("_f").cast("long").alias("n_faults")))


def recent(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """The last ``days`` days of data relative to the newest reading. The
    newest timestamp is a scalar subquery (one partial aggregate)."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def distinct_classes(df: DataFrame, cls: str) -> DataFrame:
    """A17."""
    return df.select(cls).distinct()


def scatter_points(df: DataFrame, x: str, y: str, cls: str, *,
                   fraction: float | None = None, seed_col: str | None = None) -> DataFrame:
    """(x, y, class) points; with ``fraction`` a deterministic hash sample
    (the sampling *is* the feature: charts of billions of points)."""
    out = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(cls).alias("cls"),
                    *([seed_col] if seed_col else []))
    if fraction is not None and seed_col:
        u = F.conv(F.substring(F.md5(F.col(seed_col).cast("string")), 1, 8), 16, 10).cast("long") / 4294967296.0
        out = out.filter(u < fraction).drop(seed_col)
    return out


def standard_scale(df: DataFrame, cols: Sequence[str], *, suffix: str = "_z") -> DataFrame:
    """z-score with the *population* sigma (the reference's scaler);
    mean and sigma are one global aggregate used as scalar subqueries.
    A constant column (sigma 0) scales to 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = df
    for c in cols:
        m = stats.select(f"m_{c}").scalar()
        sd = stats.select(f"s_{c}").scalar()
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.try_divide(F.col(c) - m, F.when(sd != 0, sd)),
                                                        F.when(F.col(c).isNotNull(), F.lit(0.0))))
    return out


def band_power(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *,
               period: str = "1 day", ts: str = "ts", harmonics: int = 3,
               chunk_seconds: int | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """frequency-domain features -- power of the first ``harmonics`` DFT
    bins of each (device, period) window, as native aggregates
    (sum of v*cos / v*sin over the window's sample index). The sample index is
    a running count carried over chunks and the number of samples a partial
    aggregate, so a device-day of any size is spread over its chunks and the
    sums are partial."""
    own = [*keys, "period_start"]
    x = df.withColumn("period_start", F.window(ts, period).start)
    size = materialize(x.groupBy(*own).agg(F.count(F.lit(1)).cast("double").alias("_pp_cnt")), "period-sizes")
    x = running_count(x, own, order, "_pp_idx", ts_col=ts, chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    x = null_safe_join(x.withColumn("_pp_idx", (F.col("_pp_idx") - 1).cast("double")), size, own)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in range(1, harmonics + 1):
        ang = F.lit(2.0 * 3.141592653589793 * k) * F.col("_pp_idx") / F.col("_pp_cnt")
        aggs += [F.sum(F.col(value) * F.cos(ang)).alias(f"re{k}"), F.sum(F.col(value) * F.sin(ang)).alias(f"im{k}")]
    g = x.groupBy(*keys, "period_start").agg(*aggs)
    return g.select(*keys, "period_start", "n",
                    *[(F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")).alias(f"power_{k}")
                      for k in range(1, harmonics + 1)])


def shape_report(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns and the mean of the label (fault share)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.avg(label).alias("label_mean"))
