"""Rule layer on predictions (R1-R16): status, risk, advice.

Every rule is a ``when`` chain or an array expression; boundaries are exact
(strict unless noted). NULL inputs fall through to the ``otherwise`` branch
the same way a failed comparison does in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col


def temperature_alarm(temp) -> Column:
    """> 70 high; > 50 elevated; else normal."""
    t = col(temp)
    return F.when(t > 70, "high").when(t > 50, "elevated").otherwise("normal")


def igbt_alarm(temp) -> Column:
    """R2: > 100 warn; > 85 caution; else ok."""
    t = col(temp)
    return F.when(t > 100, "warn").when(t > 85, "caution").otherwise("ok")


def inverter_health(life, risk) -> Column:
    """R3 as coded: healthy if life > 80 and risk < 0.3; warning if life > 50
    or risk < 0.7; else abnormal."""
    lp, r = col(life), col(risk)
    return (F.when((lp > 80) & (r < 0.3), "healthy")
             .when((lp > 50) | (r < 0.7), "warning")
             .otherwise("abnormal"))


def life_band(life) -> Column:
    """Capacitor life band: > 80 good, 50-80 aging, < 50 worn."""
    lp = col(life)
    return F.when(lp > 80, "good").when(lp >= 50, "aging").otherwise("worn")


def thermal_band(risk) -> Column:
    """Thermal risk band: < 0.3 normal, 0.3-0.7 elevated, > 0.7 high."""
    r = col(risk)
    return F.when(r < 0.3, "normal").when(r <= 0.7, "elevated").otherwise("high")


def inverter_recommendations(life, risk) -> Column:
    """Ordered advice list; a default line when nothing applies."""
    lp, r = col(life), col(risk)
    items = F.array_compact(F.array(
        F.when(lp < 80, F.lit("capacitor life below 80%: check capacitors")),
        F.when(lp < 50, F.lit("capacitor life critical: prepare replacement")),
        F.when(r > 0.3, F.lit("abnormal temperature rise: check cooling")),
        F.when(r > 0.7, F.lit("high cooling-failure risk: stop and inspect now")),
    ))
    return F.when(F.size(items) > 0, items).otherwise(
        F.array(F.lit("running normally: keep monitoring")))


def maintenance_action(life, risk) -> Column:
    """First matching action."""
    lp, r = col(life), col(risk)
    return (F.when(lp < 50, "replace capacitors now")
             .when(r > 0.7, "inspect cooling now")
             .when((lp < 80) | (r > 0.3), "schedule preventive maintenance")
             .otherwise("monitor"))


def pump_risk(state) -> Column:
    """Normal -> low, wear -> medium, cavitation -> high, else unknown."""
    s = col(state)
    return (F.when(s == "normal", "low").when(s == "wear", "medium")
             .when(s == "cavitation", "high").otherwise("unknown"))


def pump_advice(state, confidence) -> Column:
    """Maintenance advice per predicted pump state."""
    s, c = col(state), col(confidence)
    return (F.when((s == "normal") & (c > 0.95), "running normally: keep planned maintenance")
             .when(s == "normal", "mostly normal: monitor more often")
             .when(s == "wear", "wear detected: inspect impeller and bearings within a week; "
                                "prepare spare parts")
             .when(s == "cavitation", "cavitation detected: stop now; check inlet conditions, "
                                      "installation height and suction line; pump may need "
                                      "replacement")
             .otherwise("unknown state"))


def leak_risk(state, amount) -> Column:
    """Normal -> low; leak: amount > 60 high, > 40 medium, else low."""
    s, a = col(state), col(amount)
    return (F.when(s == "normal", "low").when(a > 60, "high").when(a > 40, "medium")
             .otherwise("low"))


def shearer_risk(state, confidence) -> Column:
    """Normal: conf > 0.95 low else medium; fault: conf > 0.9 high else medium."""
    s, c = col(state), col(confidence)
    return (F.when((s == "normal") & (c > 0.95), "low").when(s == "normal", "medium")
             .when(c > 0.9, "high").otherwise("medium"))


_FACTOR = "struct<factor:string,value:double,threshold:double,severity:string>"


def _factor(cond: Column, name: str, value: Column, threshold: float, severity: Column) -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("factor"), value.cast("double").alias("value"),
                                 F.lit(float(threshold)).alias("threshold"),
                                 severity.alias("severity")))


def shearer_risk_factors(vibration, temperature, current, oil_quality) -> Column:
    """Array of {factor, value, threshold, severity} in rule order."""
    v, t, c, o = col(vibration), col(temperature), col(current), col(oil_quality)
    sev = lambda cond: F.when(cond, F.lit("high")).otherwise(F.lit("medium"))
    return F.array_compact(F.array(
        _factor(v > 8, "vibration too high", v, 8, sev(v > 10)),
        _factor(t > 85, "temperature too high", t, 85, sev(t > 95)),
        _factor(c > 200, "current too high", c, 200, F.lit("medium")),
        _factor(o < 60, "oil quality poor", o, 60, sev(o < 50)),
    ))


def belt_status(label, p_fault) -> Column:
    """Fault: p > 0.9 stop now, p > 0.7 inspect soon, else watch; normal."""
    lb, p = col(label), col(p_fault)
    return (F.when((lb == 1) & (p > 0.9), "severe fault: stop and inspect")
             .when((lb == 1) & (p > 0.7), "fault warning: inspect soon")
             .when(lb == 1, "suspected anomaly: keep monitoring")
             .otherwise("running normally"))


def slip_grade(label, p_fault) -> Column:
    """Fault: p > 0.9 severe, > 0.7 high, else general; NULL when normal."""
    lb, p = col(label), col(p_fault)
    return (F.when((lb == 1) & (p > 0.9), "severe").when((lb == 1) & (p > 0.7), "high")
             .when(lb == 1, "general"))


def belt_fault_hints(speed_diff, current_std, current, temperature, vibration,
                     speed_thr: float = 0.5, current_std_thr: float = 15.0,
                     current_thr: float = 135.0, temp_thr: float = 70.0,
                     vib_thr: float = 7.0) -> Column:
    """Fault-type hints (slip / jam / bearing), thresholds as parameters."""
    return F.array_compact(F.array(
        F.when((col(speed_diff) > speed_thr) & (col(current_std) > current_std_thr), F.lit("slip")),
        F.when((col(current) > current_thr) & (col(temperature) > temp_thr), F.lit("jam")),
        F.when((col(vibration) > vib_thr) & (col(temperature) > temp_thr), F.lit("bearing")),
    ))


def binary_status(label) -> Column:
    """Label 1 -> fault, else normal."""
    return F.when(col(label) == 1, "fault").otherwise("normal")


def confidence_trigger(state, confidence, threshold: float = 0.95,
                       normal: str = "normal") -> Column:
    """Alert when confident and not normal (compares the class name)."""
    return (col(confidence) > threshold) & (col(state) != normal)


def shearer_fault_rule(vibration, temperature, oil_quality, noise=None) -> Column:
    """``((vib > 8) & (temp > 85)) | (oil < 60)`` (variant adds noise > 90)."""
    cond = ((col(vibration) > 8) & (col(temperature) > 85)) | (col(oil_quality) < 60)
    if noise is not None:
        cond = cond | (col(noise) > 90)
    return F.coalesce(cond, F.lit(False)).cast("int")
