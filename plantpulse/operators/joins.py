"""Joins (J1-J5) and the stats-back join used by profiles and outlier rules.

No join forces a broadcast: aggregated sides are written tables, so Spark
knows their size in bytes and broadcasts only below its own threshold; above
it the join is shuffled and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import DEFAULT_CHUNK_ROWS, epoch_micros


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | Column, how: str = "left") -> DataFrame:
    """Join ``big`` with an aggregated ``small`` side. The small side is
    written once to the shared folder, so Spark plans by its size in bytes."""
    from ..session import materialize

    return big.join(materialize(small, "join-side"), on if isinstance(on, Column) else list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``on`` in which NULL keys meet; the right side's key
    columns are dropped."""
    names = {k: f"_pp_on_{i}" for i, k in enumerate(on)}
    right = right.withColumnsRenamed(names)
    cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[n]) for k, n in names.items()])
    return left.join(right, cond, how).drop(*names.values())


def lookup(df: DataFrame, key: str, mapping: dict, out: str, default=None) -> DataFrame:
    """Label / advice dimension lookup. The dimension is a fixed literal
    map (its size is known), evaluated inline -- no join at all."""
    from itertools import chain

    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    val = F.try_element_at(m, F.col(key))
    if default is not None:
        val = F.coalesce(val, F.lit(default))
    return df.withColumn(out, val)


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str], col_a: str, col_b: str, *,
              atol: float = 1e-5, rtol: float = 1e-5, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Compare two scorings row by row (full outer join on the key).
    Returns (summary, mismatches). Summary: rows, rows missing on either
    side, mean / max absolute difference, rows beyond ``tol``, and the
    ``allclose`` flag (|a-b| <= atol + rtol*|b|)."""
    j = a.select(*key, F.col(col_a).alias("_a")).join(
        b.select(*key, F.col(col_b).alias("_b")), list(key), "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    close = d <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_b"))
    summary = j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_a").isNull()).alias("missing_a"),
        F.count_if(F.col("_b").isNull()).alias("missing_b"),
        F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"),
        F.count_if(d > tol).alias("n_beyond_tol"),
        F.bool_and(F.coalesce(close, F.lit(False))).alias("allclose"))
    mism = j.filter(~F.coalesce(close, F.lit(False))).withColumnsRenamed({"_a": col_a, "_b": col_b})
    return summary, mism


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str,
                  right_ts: str, values: Sequence[str], *, seq_left: str | None = None,
                  seq_right: str | None = None, chunk_seconds: int | None = None,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
                  prefix: str = "asof_") -> DataFrame:
    """For each left row, the latest right row of the same key with
    ``right_ts <= left_ts`` (ties: the right row sorts first). Union +
    last-non-null over the key's time order; chunk-carried so a hot key is
    spread over (key, chunk) tasks."""
    from .windows import forward_fill

    lcols = left.columns
    val_cols = [f"{prefix}{v}" for v in values]
    r = right.select(*keys, F.col(right_ts).alias("_pp_t"),
                     *[F.col(v).alias(f"{prefix}{v}") for v in values],
                     F.lit(0).alias("_pp_side"),
                     (F.col(seq_right) if seq_right else F.lit(0)).cast("long").alias("_pp_s"),
                     F.lit(True).alias("_pp_present"))
    lft = left.select(*[F.col(c) for c in lcols], F.col(left_ts).alias("_pp_t"),
                      F.lit(1).alias("_pp_side"),
                      (F.col(seq_left) if seq_left else F.lit(0)).cast("long").alias("_pp_s"))
    r_full = r
    for c in lcols:
        if c not in keys:
            r_full = r_full.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    l_full = lft.withColumns({v: F.lit(None).cast(right.schema[v[len(prefix):]].dataType) for v in val_cols}) \
                .withColumn("_pp_present", F.lit(None).cast("boolean"))
    u = l_full.unionByName(r_full)
    # carry the whole right record as one struct so its fields stay together
    u = u.withColumn("_pp_rec", F.when(F.col("_pp_side") == 0, F.struct(*val_cols)))
    filled = forward_fill(u, keys, ["_pp_t", "_pp_side", "_pp_s"], ["_pp_rec"], ts_col="_pp_t",
                          chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    return (filled.filter(F.col("_pp_side") == 1)
                  .select(*lcols, *[F.col("_pp_rec")[v].alias(v) for v in val_cols]))


def asof_forward_strict(df: DataFrame, keys: Sequence[str], ts: str, row_id: str,
                        gap_seconds: float, *, chunk_seconds: int | None = None,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """For every row, the id of the first row of the same key whose time is
    strictly later than ``ts + gap`` (NULL if none): ``next_id``.
    Probe rows at ``ts + gap`` are merged into the key's time order (after
    real rows with the same time, so equality does not match) and take the
    next real id through a chunk-carried backward fill."""
    from .windows import forward_fill

    gap_us = int(round(gap_seconds * 1_000_000))
    base = df.select(*keys, F.col(row_id).alias("_pp_id"), epoch_micros(ts).alias("_pp_us"))
    real = base.select(*keys, "_pp_us", F.lit(0).alias("_pp_kind"), F.col("_pp_id").alias("_pp_ord"),
                       F.col("_pp_id").alias("_pp_next"), F.lit(None).cast(base.schema["_pp_id"].dataType).alias("_pp_src"))
    probe = base.select(*keys, (F.col("_pp_us") + F.lit(gap_us)).alias("_pp_us"), F.lit(1).alias("_pp_kind"),
                        F.col("_pp_id").alias("_pp_ord"),
                        F.lit(None).cast(base.schema["_pp_id"].dataType).alias("_pp_next"),
                        F.col("_pp_id").alias("_pp_src"))
    u = real.unionByName(probe)
    filled = forward_fill(u, keys, ["_pp_us", "_pp_kind", "_pp_ord"], ["_pp_next"], ts_col="_pp_us",
                          chunk_seconds=chunk_seconds, chunk_rows=chunk_rows, backward=True)
    return filled.filter(F.col("_pp_kind") == 1).select(
        *keys, F.col("_pp_src").alias(row_id), F.col("_pp_next").alias("next_id"))


def asof_forward_value(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, values: Sequence[str],
                       gap_seconds: float, *, tolerance_seconds: float | None = None, prefix: str = "next_",
                       chunk_seconds: int | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Every row of ``df`` with ``values`` of the first row of its key
    strictly later than ``ts + gap`` and, with a tolerance, at most that much
    later than ``ts + gap``; NULL if there is none. One carry in time order,
    without a second look-up by id; ties by ``row_id``."""
    from .windows import forward_fill

    gap_us = int(round(gap_seconds * 1_000_000))
    names = {v: f"{prefix}{v}" for v in values}
    base = df.withColumn("_pp_us", epoch_micros(ts)).withColumn("_pp_ord", F.col(row_id))
    there = F.struct(F.col("_pp_us").alias("us"), *[F.col(v) for v in values])
    real = base.select(*keys, "_pp_us", "_pp_ord", F.lit(0).alias("_pp_kind"), there.alias("_pp_there"))
    probe = base.withColumn("_pp_us", F.col("_pp_us") + F.lit(gap_us)).withColumn("_pp_kind", F.lit(1))
    u = probe.unionByName(real, allowMissingColumns=True)
    u = forward_fill(u, keys, ["_pp_us", "_pp_kind", "_pp_ord"], ["_pp_there"], ts_col="_pp_us",
                     chunk_seconds=chunk_seconds, chunk_rows=chunk_rows, backward=True).filter(F.col("_pp_kind") == 1)
    found = F.col("_pp_us").isNotNull()
    if tolerance_seconds is not None:
        found = found & (F.col("_pp_there.us") <= F.col("_pp_us") + F.lit(int(round(tolerance_seconds * 1_000_000))))
    return u.select(*df.columns, *[F.when(found, F.col("_pp_there")[v]).alias(n) for v, n in names.items()])


def align_signals(df: DataFrame, keys: Sequence[str], ts: str, signal: str, value: str, names: dict[str, str], *,
                  period: str = "1 hour", carry: Sequence[str] = (), chunk_seconds: int | None = None,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Signals of different rates on one time grid per key, ``(keys, bucket,
    a mean per signal)``. One conditional aggregation makes the grid, so a
    bucket with any of the signals is a row; columns in ``carry`` (slow
    sensors) take the last earlier value of the key where they have none."""
    from .windows import forward_fill

    at = df.filter(F.col(signal).isin(*names)).withColumn("bucket", F.window(ts, period).start)
    grid = at.groupBy(*keys, "bucket").agg(*[F.avg(F.when(F.col(signal) == s, F.col(value))).alias(n) for s, n in names.items()])
    if not carry:
        return grid
    return forward_fill(grid, keys, ["bucket"], list(carry), ts_col="bucket", chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)


def not_yet_alerted(candidates: DataFrame, alerts: DataFrame, keys: Sequence[str], ts: str,
                    alert_ts: str, cooldown_seconds: float, *,
                    chunk_seconds: int | None = None,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """J5 (batch replay): keep candidates with no alert of the same key in
    the cool-down before them. Uses the as-of lookup of the latest alert at or
    before each candidate (never all candidate x alert pairs of a key)."""
    a = alerts.select(*keys, F.col(alert_ts).alias("_pp_at"))
    j = asof_backward(candidates, a, keys, ts, "_pp_at", ["_pp_at"], chunk_seconds=chunk_seconds, chunk_rows=chunk_rows,
                      prefix="last")
    gap = (epoch_micros(ts) - epoch_micros("last_pp_at")) / 1e6
    return j.filter(F.col("last_pp_at").isNull() | (gap > cooldown_seconds)).drop("last_pp_at")
