"""Derived-feature and scalar formula operators.

All are Column expressions: they compile into whole-stage codegen and work
the same on batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col

# Epsilons of the reference formulas.
EPS_PUMP = 1e-6
EPS_LEAK = 1e-5


def efficiency_index(flow, head, power) -> Column:
    """``flow * head / (power + 1e-6)``."""
    return col(flow) * col(head) / (col(power) + F.lit(EPS_PUMP))


def specific_power(power, flow) -> Column:
    """``power / (flow + 1e-6)``."""
    return col(power) / (col(flow) + F.lit(EPS_PUMP))


def flow_diff(supply, demand) -> Column:
    """F3."""
    return col(supply) - col(demand)


def flow_ratio(supply, demand) -> Column:
    """``supply / (demand + 1e-5)``; the epsilon also keeps ANSI mode from
    raising on a zero demand."""
    return col(supply) / (col(demand) + F.lit(EPS_LEAK))


def speed_gap(head, tail) -> Column:
    """``abs(head - tail)``."""
    return F.abs(col(head) - col(tail))


def belt_power(current, speed=None, factor: float = 2.0) -> Column:
    """``current * speed_head`` or ``current * 2.0``."""
    return col(current) * (col(speed) if speed is not None else F.lit(factor))


def temperature_baseline(temp, vib_x, vib_y, current, voltage, pressure, humidity) -> Column:
    """noise-free part of the temperature target."""
    # Coefficients of the reference formula.
    return (0.6 * col(temp)
            + 0.25 * F.pow(col(vib_x) * col(vib_y), 0.5)
            + 0.15 * F.pow(col(current), 0.8)
            + 0.08 * (col(voltage) - 230.0) * 0.5
            + 0.05 * F.sin(col(pressure) * 0.1)
            + 0.03 * F.pow(col(humidity) - 50.0, 2) / 100.0
            + 0.02 * col(vib_x) * col(current) / 10.0
            + 15.0)


def igbt_baseline(current, load_factor, ambient_temp, temp_rate) -> Column:
    """F8: ``40 + 0.4 current + 10 load + 0.5 ambient + 5 rate``."""
    return (40.0 + 0.4 * col(current) + 10.0 * col(load_factor)
            + 0.5 * col(ambient_temp) + 5.0 * col(temp_rate))


def simple_temperature(temp, vib_x, current) -> Column:
    """``0.5 t + 0.3 vx + 0.2 cur + 10``."""
    return 0.5 * col(temp) + 0.3 * col(vib_x) + 0.2 * col(current) + 10.0


def residual(observed, expected) -> Column:
    """residual used by the anomaly band (operators.quality.sigma_band)."""
    return col(observed) - col(expected)


def leak_estimate(pressure, supply, demand, temperature_factor: float = 1.0) -> Column:
    """0 while the difference is within normal loss (<= 20), else the
    difference scaled by a pressure factor (lower pressure, bigger leak)."""
    diff = col(supply) - col(demand)
    factor = (0.85 - col(pressure)) / 0.35 + 0.5
    return F.when(diff <= 20.0, F.lit(0.0)).otherwise(diff * factor * temperature_factor)


def leak_amount(supply, demand) -> Column:
    """``max(0, supply - demand)`` (NULL stays NULL)."""
    d = col(supply) - col(demand)
    return F.when(d.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), d))


def as_float32(*cols: str) -> dict[str, Column]:
    """F16: float32 cast for scoring parity."""
    return {c: F.col(c).cast("float") for c in cols}


def probability_map(probs: Column | str, classes: Sequence[str] | Column) -> Column:
    """class name -> probability; the names as a list or as an array column."""
    names = classes if isinstance(classes, Column) else F.array(*[F.lit(c) for c in classes])
    return F.map_from_arrays(names, F.col(probs) if isinstance(probs, str) else probs)


def arg_max(probs: Column | str) -> Column:
    """O2: 0-based index of the top probability (first on ties)."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def risk_factor_message(prefix: Column, factors: Column | str) -> Column:
    """header line plus one line per risk factor struct."""
    lines = F.transform(
        col(factors),
        lambda f: F.format_string("- %s: %.2f (threshold %.0f, %s)",
                                  f["factor"], f["value"], f["threshold"], f["severity"]))
    return F.concat_ws("\n", prefix, F.array_join(lines, "\n"))
