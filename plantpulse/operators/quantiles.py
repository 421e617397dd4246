"""Exact quantiles (A1, A8) by distributed selection.

``percentile`` keeps every distinct value of a group in one task. Here no task
holds a group: values are counted (partial aggregates), the counts are dealt
out by ranges of (group, value), each range is summed per group, and a running
sum over those few sums tells which ranges hold the wanted ranks. Only these
ranges are counted through.

Quantiles are linear between the two nearest ranks. NULL values are left out,
NaN is the largest value, NULL keys are a group, a group without values has no
row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import null_safe_join

_PID = "_pp_pid"


def counted_ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _n, pid): rows per distinct value, every range of (keys,
    value) in one partition, numbered in order. Written once, so that the
    numbers are the same for every reader."""
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = materialize(x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ranged = counts.repartitionByRange(*[F.col(k) for k in keys], F.col("_v"))
    return materialize(ranged.withColumn(_PID, F.spark_partition_id()), "value-ranges")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): the quantiles ``probs`` of ``value`` per group, as an array."""
    ranged = counted_ranges(df, keys, value)
    sums = ranged.groupBy(*keys, _PID).agg(F.sum("_n").alias("_s"))
    # as many rows per group as it has ranges
    along = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(along), F.lit(0)),
                             "_total": F.sum("_s").over(Window.partitionBy(*keys))})
    position = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    ranks = F.array(*[r.cast("long") for at in position for r in (F.floor(at), F.ceil(at))])
    sums = sums.withColumn("_ranks", ranks)
    holds = sums.filter(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s"))))
    holds = materialize(holds.select(*keys, _PID, "_before", "_total", "_ranks"), "rank-ranges")  # at most two per quantile and group
    inside = null_safe_join(ranged, holds, [*keys, _PID], "inner")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, _PID).orderBy("_v"))
    inside = inside.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_n"))

    def at(i: int):
        r = F.col("_ranks")[i]
        return F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_v"))).alias(f"_x{i}")
    found = inside.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(i) for i in range(2 * len(probs))])

    def between(i: int, p: float):
        where = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        share = where - F.floor(where)
        return F.when(share == 0, lo).otherwise((F.lit(1.0) - share) * lo + share * hi)
    return found.select(*keys, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias(name))
