"""Per-device window operators (W1-W10, P15-P17) that survive a hot device.

A plain ``Window.partitionBy(device)`` sends every reading of a device to one
task; if one device holds a third of 100 TB that task never finishes. Every
operator here therefore works on ``(device, chunk)`` partitions, where
``chunk`` is a fixed slice of event time:

* bounded row frames (``rows_window``) copy a *halo* of the K neighbouring
  rows from earlier / later chunks into each chunk. The halo is found on a
  "tails" table that holds at most K rows per chunk, so no step ever holds a
  whole device;
* unbounded carries (forward fill, next value, running counts) combine a
  per-chunk summary (a partial aggregate) with a running window over the
  chunk summaries.

Chunk borders are row quantiles of each device's event times (one partial
aggregate counts the rows, a second takes the quantiles of the devices above
``chunk_rows``), so bursts and outlying clocks make no large chunk; a device
below the bound is one chunk. ``chunk_seconds`` forces fixed time chunks; both
``None`` means plain windows. Keys are compared null-safe (a NULL device is a
device), and an empty key list means one global history. Results never depend
on the chunking.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C = "_pp_chunk"
_H = "_pp_halo"
_R = "_pp_rank"

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ, without a
    time-zone dependent cast (an NTZ -> LTZ cast is not monotone across DST)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c.cast("timestamp_ntz"))


def micros_of(df: DataFrame, ts: str) -> Column:
    """Epoch microseconds of a TIMESTAMP, TIMESTAMP_NTZ or (already) integer
    microsecond column -- monotone in the column's own order."""
    t = df.schema[ts].dataType
    if isinstance(t, T.TimestampType):
        return F.unix_micros(F.col(ts))
    if isinstance(t, T.TimestampNTZType):
        return epoch_micros(ts)
    return F.col(ts).cast("long")


def chunk_of(df: DataFrame, ts: str, chunk_seconds: int) -> Column:
    return F.floor(micros_of(df, ts) / F.lit(int(chunk_seconds) * 1_000_000)).cast("long")


DEFAULT_CHUNK_ROWS = 1_000_000


def with_chunks(df: DataFrame, keys: Sequence[str], ts_col: str, *, chunk_seconds: int | None = None,
                chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame | None:
    """``df`` with a chunk id column, or ``None`` when no key has more than
    ``chunk_rows`` rows, so that every chunk would be a whole key."""
    if chunk_seconds is not None:
        return df.withColumn(_C, chunk_of(df, ts_col, chunk_seconds))
    if chunk_rows is None:
        return None
    from ..session import materialize
    from .joins import null_safe_join

    us = micros_of(df, ts_col)
    big = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pp_n"))
                      .filter(F.col("_pp_n") > chunk_rows), "chunk-stats")
    widest = big.agg(F.max("_pp_n")).first()[0]
    if widest is None:
        return None
    # as many cuts as the widest key needs; others among the big get shorter chunks
    cuts = -(-int(widest) // chunk_rows)
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    rows = df.select(*keys, us.alias("_pp_us"))
    if keys:
        rows = null_safe_join(rows, big.select(*keys), keys, "left_semi")
    borders = materialize(rows.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_pp_us", shares, 20 * cuts)).alias("_pp_b")), "chunk-borders")
    if keys:
        j = null_safe_join(df, borders, keys)
    else:  # one row of ``cuts`` borders at most
        j = df.withColumn("_pp_b", F.array(*[F.lit(b) for b in borders.first()["_pp_b"]]))
    # the number of borders below a row's time
    chunk = F.coalesce(F.size(F.filter("_pp_b", lambda b: b < us)), F.lit(0)).cast("long")
    return j.withColumn(_C, F.when(F.col("_pp_b").isNull(), F.lit(0).cast("long")).otherwise(chunk)).drop("_pp_b")


def _rows_bound(df: DataFrame, keys: Sequence[str], chunk_seconds: int | None, chunk_rows: int | None) -> int | None:
    """``chunk_rows`` for steps that follow each other on the same rows: ``None``
    when no key has more, so that none of them counts (and computes the steps
    before it) again."""
    if chunk_seconds is not None or chunk_rows is None:
        return chunk_rows
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pp_n")).agg(F.max("_pp_n")).first()[0]
    return chunk_rows if (most or 0) > chunk_rows else None


def _order_cols(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _halo(base: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
          forward: bool) -> DataFrame:
    """Copies of the k rows that precede (forward=False) or follow
    (forward=True) each chunk, re-labelled with the chunk they serve."""
    # Reversing every order turns "following" into "preceding".
    rev = forward
    in_chunk = Window.partitionBy(*keys, _C).orderBy(*_order_cols(order, not rev))
    tails = base.withColumn(_R, F.row_number().over(in_chunk)).filter(F.col(_R) <= k).drop(_R)
    along = Window.partitionBy(*keys).orderBy(
        F.col(_C).desc() if rev else F.col(_C).asc(), *_order_cols(order, rev))
    is_start = F.coalesce(F.lag(_C, 1).over(along) != F.col(_C), F.lit(True))
    tails = tails.withColumn("_pp_start", is_start)
    targets = F.collect_list(F.when(F.col("_pp_start"), F.col(_C))).over(along.rowsBetween(1, k))
    return (tails.withColumn("_pp_targets", targets)
                 .drop("_pp_start", _C)
                 .select("*", F.explode("_pp_targets").alias(_C))
                 .drop("_pp_targets"))


def rows_window(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                columns: Callable[[WindowSpec], dict[str, Column]], *,
                preceding: int, following: int = 0, ts_col: str | None = None,
                chunk_seconds: int | None = None,
                chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``columns(w)`` computed over ``w = partitionBy(keys).orderBy(order)``
    where every frame / offset used stays within ``preceding`` rows before and
    ``following`` rows after the current row. ``order`` must be a total order
    within a key (e.g. ``ts, event_id``). Returns every input row once."""
    base = with_chunks(df, keys, ts_col or order[0], chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    if base is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(columns(w))
    parts = [base.withColumn(_H, F.lit(False))]
    if preceding > 0:
        parts.append(_halo(base, keys, order, preceding, forward=False).withColumn(_H, F.lit(True)))
    if following > 0:
        parts.append(_halo(base, keys, order, following, forward=True).withColumn(_H, F.lit(True)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(*keys, _C).orderBy(*order)
    return u.withColumns(columns(w)).filter(~F.col(_H)).drop(_H, _C)


def _chunk_carry(base: DataFrame, keys: Sequence[str], summary: dict[str, Column],
                 carry: Callable[[str, WindowSpec], Column]) -> DataFrame:
    """Per (key, chunk) summary aggregated map-side, then carried across the
    earlier chunks of the key (a table of #keys x #chunks rows)."""
    s = base.groupBy(*keys, _C).agg(*[v.alias(k) for k, v in summary.items()])
    prev = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    return s.select(*keys, _C, *[carry(k, prev).alias(f"{k}_carry") for k in summary])


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 cols: Sequence[str], *, ts_col: str | None = None,
                 chunk_seconds: int | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
                 backward: bool = False) -> DataFrame:
    """Replace NULL by the last earlier non-NULL value of the key
    (leading NULLs stay NULL). ``backward=True`` takes the next later value
    instead (used by interpolation): the same running frame over the reversed
    order, since a frame that ends with the partition is summed anew for every
    row."""
    base = with_chunks(df, keys, ts_col or order[0], chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    if base is None:
        w = Window.partitionBy(*keys).orderBy(*_order_cols(order, backward)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    ordkey = F.struct(*[F.col(o) for o in order])
    # last (first) non-null value of each chunk, as a partial aggregate
    pick = F.min_by if backward else F.max_by
    summary = {f"_pp_{c}": pick(F.col(c), F.when(F.col(c).isNotNull(), ordkey)) for c in cols}
    if backward:
        later = Window.partitionBy(*keys).orderBy(F.col(_C).desc()).rowsBetween(Window.unboundedPreceding, -1)
        s = base.groupBy(*keys, _C).agg(*[v.alias(k) for k, v in summary.items()])
        carried = s.select(*keys, _C, *[F.last(k, ignorenulls=True).over(later).alias(f"{k}_carry")
                                        for k in summary])
    else:
        carried = _chunk_carry(base, keys, summary, lambda k, w: F.last(k, ignorenulls=True).over(w))
    w = Window.partitionBy(*keys, _C).orderBy(*_order_cols(order, backward)).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"_pp_{c}_local": F.last(c, ignorenulls=True).over(w) for c in cols})
    from .joins import null_safe_join

    out = null_safe_join(local, carried, [*keys, _C])
    return (out.withColumns({c: F.coalesce(F.col(f"_pp_{c}_local"), F.col(f"_pp_{c}_carry"))
                             for c in cols})
               .drop(_C, *[f"_pp_{c}_local" for c in cols], *[f"_pp_{c}_carry" for c in cols]))


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, of: str | None = None,
                  ts_col: str | None = None, chunk_seconds: int | None = None,
                  chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Number of readings of the key up to and including the current one
    (whole history; only non-NULL ``of`` when given), chunk-carried."""
    one = F.lit(1) if of is None else F.col(of)
    base = with_chunks(df, keys, ts_col or order[0], chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    if base is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.count(one).over(w))
    carried = _chunk_carry(base, keys, {"_pp_n": F.count(one)},
                           lambda k, w: F.coalesce(F.sum(k).over(w), F.lit(0)))
    w = Window.partitionBy(*keys, _C).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    from .joins import null_safe_join

    return (null_safe_join(base.withColumn("_pp_local", F.count(one).over(w)), carried, [*keys, _C])
                .withColumn(name, F.col("_pp_local") + F.coalesce(F.col("_pp_n_carry"), F.lit(0)))
                .drop(_C, "_pp_local", "_pp_n_carry"))


def gap_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, max_gap: float,
                 ts_col: str | None = None, chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Number of silences of more than ``max_gap`` seconds between neighbouring
    readings of the key, up to the current one: readings of equal number are an
    unbroken stretch. Chunk-carried; a reading without a time breaks nothing."""
    ts_col = ts_col or order[0]
    limit = F.lit(round(max_gap * 1_000_000))
    chunk_rows = _rows_bound(df, keys, chunk_seconds, chunk_rows)

    def cols(w: WindowSpec) -> dict[str, Column]:
        us = micros_of(df, ts_col)
        return {"_pp_gap": F.when(us - F.lag(us, 1).over(w) > limit, F.lit(1))}
    out = rows_window(df, keys, order, cols, preceding=1, ts_col=ts_col,
                      chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    return running_count(out, keys, order, name, of="_pp_gap", ts_col=ts_col,
                         chunk_seconds=chunk_seconds, chunk_rows=chunk_rows).drop("_pp_gap")


# --------------------------------------------------------------------------
# Feature windows of the jobs


def lagged_window_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                           ripple: str, temperature: str, load: str, size: int = 20,
                           include_current: bool = False, max_gap: float | None = None, ts_col: str | None = None,
                           chunk_seconds: int | None = None, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W1 (training, rows i-size..i-1) / W2 (serving, rows i-size+1..i).

    Adds mean_ripple, std_ripple (population), mean_temp, temp_rise
    (last - first), mean_load, temp_range (max - min) and ``n_window``.
    W1 keeps only rows with a full window (n -> n - size per device); W2 marks
    short windows with ``window_status = 'insufficient'``. With ``max_gap`` no
    window reaches over a silence of more seconds: filling starts anew."""
    if max_gap is not None:
        chunk_rows = _rows_bound(df, keys, chunk_seconds, chunk_rows)
        df = gap_segments(df, keys, order, "_pp_segment", max_gap=max_gap, ts_col=ts_col,
                          chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
        if chunk_rows is not None:  # the stretches of a big device are counted and cut, too
            from ..session import materialize
            df = materialize(df, "segments")
        return lagged_window_features(
            df, [*keys, "_pp_segment"], order, ripple=ripple, temperature=temperature, load=load, size=size,
            include_current=include_current, ts_col=ts_col, chunk_seconds=chunk_seconds,
            chunk_rows=chunk_rows).drop("_pp_segment")
    lo, hi = (-(size - 1), 0) if include_current else (-size, -1)

    def cols(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(lo, hi)
        return {
            "n_window": F.count(F.col(temperature)).over(f),
            "mean_ripple": F.avg(ripple).over(f),
            "std_ripple": F.stddev_pop(ripple).over(f),
            "mean_temp": F.avg(temperature).over(f),
            "temp_rise": F.last(temperature).over(f) - F.first(temperature).over(f),
            "mean_load": F.avg(load).over(f),
            "temp_range": F.max(temperature).over(f) - F.min(temperature).over(f),
        }

    out = rows_window(df, keys, order, cols, preceding=-lo, following=max(hi, 0),
                      ts_col=ts_col, chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    if include_current:
        return out.withColumn("window_status",
                              F.when(F.col("n_window") < size, "insufficient").otherwise("ready"))
    return out.filter(F.col("n_window") == size)


def rolling_std(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str,
                name: str, *, size: int = 5, ddof: int = 1, min_n: int = 1,
                ts_col: str | None = None, chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W3 (``ddof=1``: sample std over the last ``size`` rows, NULL for a
    single row) and W4 (``ddof=0``, 0 until the key's history holds ``min_n``
    readings of ``col``)."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-(size - 1), 0)
        std = F.stddev_samp(col).over(f) if ddof == 1 else F.stddev_pop(col).over(f)
        return {name: std if min_n > size else F.when(F.count(F.col(col)).over(f) >= F.lit(min_n), std).otherwise(
            F.lit(0.0) if ddof == 0 else F.lit(None).cast("double"))}
    out = rows_window(df, keys, order, cols, preceding=size - 1, ts_col=ts_col,
                      chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    if min_n > size:
        # more than the frame can hold: count the history
        out = running_count(out, keys, order, "_pp_seen", of=col, ts_col=ts_col, chunk_seconds=chunk_seconds,
                            chunk_rows=chunk_rows)
        none = F.lit(0.0) if ddof == 0 else F.lit(None).cast("double")
        out = out.withColumn(name, F.when(F.col("_pp_seen") >= min_n, F.col(name)).otherwise(none)).drop("_pp_seen")
    return out


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str,
                 name: str, *, size: int = 10, ts_col: str | None = None,
                 chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``rolling(size).mean()`` -- NULL until ``size`` readings exist."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-(size - 1), 0)
        return {name: F.when(F.count(F.col(col)).over(f) == size, F.avg(col).over(f))}
    return rows_window(df, keys, order, cols, preceding=size - 1, ts_col=ts_col,
                       chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)


def first_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str,
                     name: str, *, per_second: bool = False, ts_col: str | None = None,
                     chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W6 ``diff()`` (NULL on the first row) and W7 (rate per second: the
    difference divided by the elapsed seconds; NULL when no time passed)."""
    ts_col = ts_col or order[0]

    def cols(w: WindowSpec) -> dict[str, Column]:
        d = F.col(col) - F.lag(col, 1).over(w)
        if per_second:
            dt = (epoch_micros(ts_col) - F.lag(epoch_micros(ts_col), 1).over(w)) / 1e6
            d = F.try_divide(d, F.when(dt != 0, dt))
        return {name: d}
    return rows_window(df, keys, order, cols, preceding=1, ts_col=ts_col,
                       chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str,
                 name: str, *, half_width: int = 2, median: bool = False,
                 ts_col: str | None = None, chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Noise filter -- centred moving average (or median) over
    ``rowsBetween(-k, k)``."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-half_width, half_width)
        if not median:
            return {name: F.avg(col).over(f)}
        # Spark's median takes no ordered frame; a frame holds 2k + 1 values at most
        held = F.array_sort(F.collect_list(col).over(f))
        n = F.size(held)
        middle = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2.0
        return {name: F.when(n > 0, middle)}
    return rows_window(df, keys, order, cols, preceding=half_width, following=half_width,
                       ts_col=ts_col, chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str,
                name: str, *, ts_col: str, max_gap: float | None = None, chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Time-linear interpolation of NULL gaps between the previous and
    next known values; edges stay NULL, and so do gaps whose known values lie
    more than ``max_gap`` seconds apart."""
    us = "_pp_us"
    tmp = (df.withColumn(us, epoch_micros(ts_col))
             .withColumn("_pp_pv", F.col(col)).withColumn("_pp_pt", F.when(F.col(col).isNotNull(), F.col(us)))
             .withColumn("_pp_nv", F.col(col)).withColumn("_pp_nt", F.when(F.col(col).isNotNull(), F.col(us))))
    tmp = forward_fill(tmp, keys, order, ["_pp_pv", "_pp_pt"], ts_col=ts_col,
                       chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    tmp = forward_fill(tmp, keys, order, ["_pp_nv", "_pp_nt"], ts_col=ts_col,
                       chunk_seconds=chunk_seconds, chunk_rows=chunk_rows, backward=True)
    frac = F.try_divide((F.col(us) - F.col("_pp_pt")).cast("double"),
                        F.when(F.col("_pp_nt") != F.col("_pp_pt"),
                               (F.col("_pp_nt") - F.col("_pp_pt")).cast("double")))
    between = F.col("_pp_pv") + (F.col("_pp_nv") - F.col("_pp_pv")) * frac
    if max_gap is not None:
        between = F.when(F.col("_pp_nt") - F.col("_pp_pt") <= F.lit(round(max_gap * 1_000_000)), between)
    val = F.when(F.col(col).isNotNull(), F.col(col)).otherwise(between)
    return tmp.withColumn(name, val).drop(us, "_pp_pv", "_pp_pt", "_pp_nv", "_pp_nt")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5, *,
              ts_col: str | None = None, chunk_seconds: int | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Keep every n-th reading of a device (1-based row number % n == 0)."""
    df = running_count(df, keys, order, "_pp_rn", ts_col=ts_col, chunk_seconds=chunk_seconds, chunk_rows=chunk_rows)
    return df.filter(F.col("_pp_rn") % n == 0).drop("_pp_rn")
