"""Batch alert cool-down (T3) and alert records.

Rule (from the monitors): an event fires if its key never fired before, or
if more than ``cooldown`` seconds (strict) passed since the key's last
*fired* event; suppressed events do not move the clock.

The rule is greedy -- every emit depends on the previous emit -- so it is
not a window function. Folding each key's events in order would put a hot
key (a device in permanent fault) into one task. Instead, one plan for every
size:

1. an event more than ``cooldown`` after the key's event before it always
   fires (whatever fired last is at least as old): these events, and each
   key's first, start the *runs*;
2. ``next(e)`` = first event of the key strictly later than ``ts(e) +
   cooldown`` -- a skew-safe as-of lookup (chunked, see ``joins``). The fired
   events of a run are the chain ``e0, next(e0), next(next(e0)), ...`` from its
   start, up to the next run's start, which needs no link;
3. the chains are expanded by pointer doubling: level k holds
   ``next^(2^k)``; each level is one self-join on the (unique) event id, and
   the expansion walks the levels top-down. Work is O(n log L) for runs of L
   links, every join is keyed by event id (no skew), and every level is
   written to the shared checkpoint folder so a lost executor only re-runs
   one level.

NULL keys are one key of their own; an empty key list is one global clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import asof_forward_strict
from .windows import DEFAULT_CHUNK_ROWS, micros_of, rows_window


def cooldown_fired(df: DataFrame, keys: Sequence[str], ts: str, row_id: str,
                   cooldown_seconds: float, *, chunk_seconds: int | None = None,
                   chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Rows of ``df`` that fire under the cool-down rule (``row_id`` must be
    unique). Returns ``df``'s columns."""
    gap_us = int(round(cooldown_seconds * 1_000_000))
    names = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    cols = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("_k")]
    ids = df.select(*cols, F.col(row_id).alias("_id"), F.col(ts).alias("_ts"), micros_of(df, ts).alias("_us"))
    how = {"chunk_seconds": chunk_seconds, "chunk_rows": chunk_rows}
    marked = rows_window(ids, names, ["_us", "_id"], lambda w: {"_before": F.lag("_us", 1).over(w)},
                         preceding=1, ts_col="_us", **how)
    starts = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > gap_us)
    marked = materialize(marked.select("_id", starts.alias("_start")), "cooldown-runs")
    fired = marked.filter("_start").select("_id")
    nxt = asof_forward_strict(ids, names, "_ts", "_id", cooldown_seconds, **how)
    # Levels keep only live jumps (id -> next^(2^k)(id)); a missing id means
    # "no jump". No NULL join keys, so no shuffle partition collects the rows
    # whose chains have ended, and every level is smaller than the last.
    jumps = nxt.filter(F.col("next_id").isNotNull()).select("_id", F.col("next_id").alias("_nx"))
    jumps = jumps.join(fired.select(F.col("_id").alias("_nx")), "_nx", "left_anti")
    level, levels = materialize(jumps.select("_id", "_nx"), "cooldown-l0"), []
    while not level.isEmpty():
        levels.append(level)
        a, b = level.alias("a"), level.alias("b")
        up = (a.join(b, F.col("a._nx") == F.col("b._id"))
               .select(F.col("a._id").alias("_id"), F.col("b._nx").alias("_nx")))
        level = materialize(up, f"cooldown-l{len(levels)}")
    for lv in reversed(levels):
        jumped = fired.join(lv, "_id").select(F.col("_nx").alias("_id"))
        fired = materialize(fired.unionByName(jumped), "cooldown-s")
    return df.join(fired.withColumnRenamed("_id", row_id), row_id, "left_semi")


def alert_records(fired: DataFrame, device: str, ts: str, state: str,
                  score: str | None = None) -> DataFrame:
    """The alert table row -- device, state, alert time and a message with
    the wall-clock time (F18) and, when given, the score as a percent (F17)."""
    msg = F.concat(F.lit("device "), F.col(device).cast("string"), F.lit(" "), F.col(state),
                   F.lit(" at "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    if score:
        msg = F.concat(msg, F.lit(" (p="), F.format_string("%.2f%%", F.col(score) * 100.0), F.lit(")"))
    return fired.select(device, state, F.col(ts).alias("alert_ts"), msg.alias("message"))
