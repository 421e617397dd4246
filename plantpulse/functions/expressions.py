"""Small NULL-safe column helpers shared by features, rules and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """``clip(lo, hi)``. ``least``/``greatest`` skip NULLs, so a NULL
    input is guarded to stay NULL (pandas keeps NaN)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL instead of raising under ANSI mode."""
    return F.try_divide(col(num), col(den))


def pct_text(c: Column | str, decimals: int = 2) -> Column:
    """``f"{x:.2%}"`` -> ``'12.34%'``."""
    return F.format_string(f"%.{decimals}f%%", col(c) * 100.0)


def ts_text(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """wall-clock formatting."""
    return F.date_format(col(c), pattern)


def rnd(c: Column | str, scale: int = 6) -> Column:
    """Round half away from zero on the scaled value ``x * 10^scale`` -- the
    way DuckDB rounds a double -- so both engines give bit-identical
    doubles (rounding the exact binary value instead differs on near-ties)."""
    f = float(10 ** scale)
    return F.round(col(c) * F.lit(f)) / F.lit(f)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact seconds (microsecond resolution) between two timestamps."""
    return (F.unix_micros(col(later).cast("timestamp"))
            - F.unix_micros(col(earlier).cast("timestamp"))) / 1e6
