"""Formula features and rule layers on the sensor views (F1-F12, F19-F20,
O2, P18, R1-R2, R7-R16, S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rnd

from ..functions import features as X
from ..functions import rules as R
from ..sources.readers import parse_json, read_table, to_json_response
from .registry import query
from .views import (LEAK_READINGS_SQL, PUMP_READINGS_SQL, SHEARER_READINGS_SQL,
                    TEMPERATURE_READINGS_SQL, leak_readings, pump_readings, shearer_readings,
                    temperature_readings)


def _r6(*cols: str) -> list:
    return [rnd(c, 6).alias(c) for c in cols]


# ------------------------------------------------------------------ pump

def pump_confidence() -> F.Column:
    """Stand-in confidence of a pump prediction: grows with the head."""
    return F.least(F.lit(1.0), F.lit(0.5) + F.col("head") / F.lit(100.0))


@query("pump_scoring", f"""
WITH r AS ({PUMP_READINGS_SQL}),
s AS (SELECT *, flow * head / (power + 1e-6) AS efficiency_index, power / (flow + 1e-6) AS specific_power,
             least(1.0, 0.5 + head / 100.0) AS confidence FROM r)
SELECT state, round(efficiency_index, 6) AS efficiency_index, round(specific_power, 6) AS specific_power,
       round(confidence, 6) AS confidence,
       CASE state WHEN 'normal' THEN 'low' WHEN 'wear' THEN 'medium' WHEN 'cavitation' THEN 'high'
                  ELSE 'unknown' END AS risk,
       CASE WHEN state = 'normal' AND confidence > 0.95 THEN 'running normally: keep planned maintenance'
            WHEN state = 'normal' THEN 'mostly normal: monitor more often'
            WHEN state = 'wear' THEN 'wear detected: inspect impeller and bearings within a week; prepare spare parts'
            WHEN state = 'cavitation' THEN 'cavitation detected: stop now; check inlet conditions, installation height and suction line; pump may need replacement'
            ELSE 'unknown state' END AS advice,
       coalesce(confidence > 0.95 AND state <> 'normal', false) AS alert
FROM s
""")
def pump_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """F1 + F2 -> R7 risk, R8 advice, R16 confidence trigger; a reading without
    flow keeps its row, without the ratios."""
    s = pump_readings(spark, sf).withColumns({
        "efficiency_index": X.efficiency_index("flow", "head", "power"),
        "specific_power": X.specific_power("power", "flow"),
        "confidence": pump_confidence()})
    return s.select(
        "state", *_r6("efficiency_index", "specific_power", "confidence"),
        R.pump_risk("state").alias("risk"),
        R.pump_advice("state", "confidence").alias("advice"),
        F.coalesce(R.confidence_trigger("state", "confidence"), F.lit(False)).alias("alert"))


# ------------------------------------------------------------------ leak

@query("leak_scoring", f"""
WITH r AS ({LEAK_READINGS_SQL}),
s AS (SELECT *, supply_flow - demand_flow AS flow_diff, supply_flow / (demand_flow + 1e-5) AS flow_ratio,
             CASE WHEN supply_flow - demand_flow <= 20 THEN 0.0
                  ELSE (supply_flow - demand_flow) * ((0.85 - pressure) / 0.35 + 0.5) * 1.0 END AS leak_estimate,
             greatest(0.0, supply_flow - demand_flow) AS leak_amount
      FROM r)
SELECT l_orderkey, l_linenumber, state, round(flow_diff, 6) AS flow_diff, round(flow_ratio, 6) AS flow_ratio,
       round(leak_estimate, 6) AS leak_estimate, round(leak_amount, 6) AS leak_amount,
       CASE WHEN state = 'normal' THEN 'low' WHEN leak_amount > 60 THEN 'high'
            WHEN leak_amount > 40 THEN 'medium' ELSE 'low' END AS risk
FROM s
""")
def leak_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """F3 + F4 + F11 + F12 -> R9 leak risk."""
    df = leak_readings(spark, sf)
    s = df.withColumns({
        "flow_diff": X.flow_diff("supply_flow", "demand_flow"),
        "flow_ratio": X.flow_ratio("supply_flow", "demand_flow"),
        "leak_estimate": X.leak_estimate("pressure", "supply_flow", "demand_flow"),
        "leak_amount": X.leak_amount("supply_flow", "demand_flow")})
    return s.select("l_orderkey", "l_linenumber", "state",
                    *_r6("flow_diff", "flow_ratio", "leak_estimate", "leak_amount"),
                    R.leak_risk("state", "leak_amount").alias("risk"))


# ------------------------------------------------------------------ temperature

@query("temperature_baseline", f"""
WITH r AS ({TEMPERATURE_READINGS_SQL}),
s AS (SELECT *, 0.6 * temp_current + 0.25 * pow(vibration_x * vibration_y, 0.5)
                + 0.15 * pow(current, 0.8) + 0.08 * (voltage - 230.0) * 0.5
                + 0.05 * sin(pressure * 0.1) + 0.03 * pow(humidity - 50.0, 2) / 100.0
                + 0.02 * vibration_x * current / 10.0 + 15.0 AS predicted_temp,
             0.5 * temp_current + 0.3 * vibration_x + 0.2 * current + 10.0 AS simple_temp
      FROM r)
SELECT l_orderkey, l_linenumber, round(predicted_temp, 6) AS predicted_temp,
       round(simple_temp, 6) AS simple_temp,
       CASE WHEN predicted_temp > 70 THEN 'high' WHEN predicted_temp > 50 THEN 'elevated'
            ELSE 'normal' END AS alarm
FROM s
""")
def temperature_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """F7 (temperature model formula) + F9 (linear formula) -> R1 alarm."""
    df = temperature_readings(spark, sf)
    s = df.withColumns({
        "predicted_temp": X.temperature_baseline("temp_current", "vibration_x", "vibration_y",
                                                 "current", "voltage", "pressure", "humidity"),
        "simple_temp": X.simple_temperature("temp_current", "vibration_x", "current")})
    return s.select("l_orderkey", "l_linenumber", *_r6("predicted_temp", "simple_temp"),
                    R.temperature_alarm("predicted_temp").alias("alarm"))


@query("temperature_summary", f"""
WITH r AS ({TEMPERATURE_READINGS_SQL}),
s AS (SELECT 0.6 * temp_current + 0.25 * pow(vibration_x * vibration_y, 0.5)
                + 0.15 * pow(current, 0.8) + 0.08 * (voltage - 230.0) * 0.5
                + 0.05 * sin(pressure * 0.1) + 0.03 * pow(humidity - 50.0, 2) / 100.0
                + 0.02 * vibration_x * current / 10.0 + 15.0 AS p FROM r)
SELECT round(avg(p), 6) AS mean, round(min(p), 6) AS "min", round(max(p), 6) AS "max", count(p) AS n FROM s
""")
def temperature_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A5: mean / min / max of the predictions."""
    from ..operators.profile import prediction_summary

    df = temperature_readings(spark, sf).withColumn(
        "p", X.temperature_baseline("temp_current", "vibration_x", "vibration_y", "current",
                                    "voltage", "pressure", "humidity"))
    s = prediction_summary(df, "p")
    return s.select(*_r6("mean", "min", "max"), "n")


# ------------------------------------------------------------------ IGBT

@query("igbt_baseline", """
WITH r AS (SELECT l_orderkey, l_linenumber, 2.0 * l_quantity AS current, 10.0 * l_discount AS load_factor,
                  20.0 + 100.0 * l_tax AS ambient_temp, l_linenumber / 4.0 - 0.5 AS temp_rate FROM lineitem),
s AS (SELECT *, 40.0 + 0.4 * current + 10.0 * load_factor + 0.5 * ambient_temp + 5.0 * temp_rate AS target_temp
      FROM r)
SELECT l_orderkey, l_linenumber, round(target_temp, 6) AS target_temp,
       CASE WHEN target_temp > 100 THEN 'warn' WHEN target_temp > 85 THEN 'caution' ELSE 'ok' END AS alarm
FROM s
""")
def igbt_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """F8 (IGBT formula) -> R2 alarm."""
    li = read_table(spark, sf, "lineitem")
    r = li.select("l_orderkey", "l_linenumber",
                  (F.lit(2.0) * F.col("l_quantity")).alias("current"),
                  (F.lit(10.0) * F.col("l_discount")).alias("load_factor"),
                  (F.lit(20.0) + F.lit(100.0) * F.col("l_tax")).alias("ambient_temp"),
                  (F.col("l_linenumber") / F.lit(4.0) - F.lit(0.5)).alias("temp_rate"))
    s = r.withColumn("target_temp", X.igbt_baseline("current", "load_factor", "ambient_temp", "temp_rate"))
    return s.select("l_orderkey", "l_linenumber", *_r6("target_temp"),
                    R.igbt_alarm("target_temp").alias("alarm"))


# ------------------------------------------------------------------ shearer

def shearer_confidence() -> F.Column:
    return F.lit(0.5) + F.col("pressure") / F.lit(40.0)


@query("shearer_rules", f"""
WITH r AS ({SHEARER_READINGS_SQL}),
s AS (SELECT *, CAST(coalesce((vibration > 8 AND temperature > 85) OR oil_quality < 60, false) AS INTEGER) AS fault,
             0.5 + pressure / 40.0 AS confidence FROM r)
SELECT l_orderkey, l_linenumber, fault,
       CASE WHEN fault = 1 THEN 'fault' ELSE 'normal' END AS status,
       CASE WHEN fault = 0 AND confidence > 0.95 THEN 'low' WHEN fault = 0 THEN 'medium'
            WHEN confidence > 0.9 THEN 'high' ELSE 'medium' END AS risk,
       concat_ws(', ',
         CASE WHEN vibration > 8 THEN 'vibration too high (' || CASE WHEN vibration > 10 THEN 'high' ELSE 'medium' END || ')' END,
         CASE WHEN temperature > 85 THEN 'temperature too high (' || CASE WHEN temperature > 95 THEN 'high' ELSE 'medium' END || ')' END,
         CASE WHEN current > 200 THEN 'current too high (medium)' END,
         CASE WHEN oil_quality < 60 THEN 'oil quality poor (' || CASE WHEN oil_quality < 50 THEN 'high' ELSE 'medium' END || ')' END
       ) AS risk_factors,
       CAST((vibration > 8)::INT + (temperature > 85)::INT + (current > 200)::INT + (oil_quality < 60)::INT AS INTEGER) AS n_factors,
       coalesce(fault = 1 AND confidence > 0.8, false) AS alert_gate
FROM s
""")
def shearer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P18 fault rule -> R15 status, R10 risk, R11 risk factors, T4 gate."""
    df = shearer_readings(spark, sf).withColumns({
        "fault": R.shearer_fault_rule("vibration", "temperature", "oil_quality"),
        "confidence": shearer_confidence()})
    factors = R.shearer_risk_factors("vibration", "temperature", "current", "oil_quality")
    state = F.when(F.col("fault") == 1, "fault").otherwise("normal")
    return df.select(
        "l_orderkey", "l_linenumber", "fault", R.binary_status("fault").alias("status"),
        R.shearer_risk(state, "confidence").alias("risk"),
        F.array_join(F.transform(factors, lambda f: F.concat(f["factor"], F.lit(" ("), f["severity"],
                                                               F.lit(")"))), ", ").alias("risk_factors"),
        F.size(factors).alias("n_factors"),
        F.coalesce((F.col("fault") == 1) & (F.col("confidence") > 0.8), F.lit(False)).alias("alert_gate"))


# ------------------------------------------------------------------ belt

_BELT_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, 100.0 + 0.8 * l_quantity AS current,
                  2.0 + 10.0 * l_discount AS speed_head,
                  2.0 + 10.0 * l_discount - 10.0 * l_tax AS speed_tail,
                  l_quantity / 5.0 AS vibration, 40.0 + 600.0 * l_tax AS temperature,
                  10.0 * l_discount - 0.05 AS p_fault FROM lineitem),
s AS (SELECT *, abs(speed_head - speed_tail) AS speed_diff, current * speed_head AS power,
             current * 2.0 AS power_est, CASE WHEN p_fault > 0.5 THEN 1 ELSE 0 END AS label FROM r)"""


def _belt(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    r = li.select("l_orderkey", "l_linenumber",
                  (F.lit(100.0) + F.lit(0.8) * F.col("l_quantity")).alias("current"),
                  (F.lit(2.0) + F.lit(10.0) * F.col("l_discount")).alias("speed_head"),
                  (F.lit(2.0) + F.lit(10.0) * F.col("l_discount") - F.lit(10.0) * F.col("l_tax")).alias("speed_tail"),
                  (F.col("l_quantity") / F.lit(5.0)).alias("vibration"),
                  (F.lit(40.0) + F.lit(600.0) * F.col("l_tax")).alias("temperature"),
                  (F.lit(10.0) * F.col("l_discount") - F.lit(0.05)).alias("p_fault"))
    return r.withColumns({
        "speed_diff": X.speed_gap("speed_head", "speed_tail"),
        "power": X.belt_power("current", "speed_head"),
        "power_est": X.belt_power("current"),
        "label": F.when(F.col("p_fault") > 0.5, 1).otherwise(0)})


@query("belt_rules", _BELT_SQL + """
SELECT l_orderkey, l_linenumber, label, round(speed_diff, 6) AS speed_diff, round(power, 6) AS power,
       round(power_est, 6) AS power_est,
       CASE WHEN label = 1 AND p_fault > 0.9 THEN 'severe fault: stop and inspect'
            WHEN label = 1 AND p_fault > 0.7 THEN 'fault warning: inspect soon'
            WHEN label = 1 THEN 'suspected anomaly: keep monitoring' ELSE 'running normally' END AS status,
       CASE WHEN label = 1 AND p_fault > 0.9 THEN 'severe' WHEN label = 1 AND p_fault > 0.7 THEN 'high'
            WHEN label = 1 THEN 'general' END AS grade,
       concat_ws(',', CASE WHEN speed_diff > 0.5 AND vibration > 5.0 THEN 'slip' END,
                      CASE WHEN current > 135 AND temperature > 70 THEN 'jam' END,
                      CASE WHEN vibration > 7 AND temperature > 70 THEN 'bearing' END) AS hints
FROM s
""")
def belt_rules(spark: SparkSession, sf: str) -> DataFrame:
    """F5 speed gap, F6 power estimates -> R12 status, R13 grade, R14 hints."""
    s = _belt(spark, sf)
    hints = R.belt_fault_hints("speed_diff", "vibration", "current", "temperature", "vibration",
                               speed_thr=0.5, current_std_thr=5.0)
    return s.select("l_orderkey", "l_linenumber", "label", *_r6("speed_diff", "power", "power_est"),
                    R.belt_status("label", "p_fault").alias("status"),
                    R.slip_grade("label", "p_fault").alias("grade"),
                    F.array_join(hints, ",").alias("hints"))


# ------------------------------------------------------------------ JSON and probabilities

@query("json_request_response", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_object('status', CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50
                                  THEN 'fault' ELSE 'normal' END,
                   'k', CAST(json_extract_string(props, '$.k') AS INTEGER),
                   'message', event_type)::VARCHAR AS response
FROM events
""")
def json_request_response(spark: SparkSession, sf: str) -> DataFrame:
    """JSON body -> named fields -> JSON response record."""
    e = read_table(spark, sf, "events")
    body = parse_json("props", "k INT")
    p = e.select("event_id", "event_type", body.alias("req"))
    k = F.col("req.k")
    return p.select("event_id", k.alias("k"), to_json_response(
        status=F.when(k > 50, "fault").otherwise("normal"), k=k,
        message=F.col("event_type")).alias("response"))


@query("embedding_argmax", """
WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings),
q AS (SELECT vec_id, label, list_transform(a, lambda x: x / (list_sum(a) + 1e-9)) AS probs FROM p)
SELECT vec_id, label, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted,
       'class ' || (list_position(probs, list_max(probs)) - 1) AS predicted_name,
       round(list_max(probs), 6) AS confidence, round(probs[2], 6) AS p_second, round(probs[len(probs)], 6) AS p_last
FROM q
""")
def embedding_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """O2 arg-max class and confidence over the whole vector, F20 access to
    single probabilities by name."""
    e = read_table(spark, sf, "embeddings")
    p = e.select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, y: s + y)
    p = p.select("vec_id", "label", F.transform("a", lambda x: x / (total + 1e-9)).alias("probs"))
    idx = X.arg_max("probs")
    names = F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: F.concat(F.lit("class "), i.cast("string")))
    pm = X.probability_map("probs", names)
    return p.select("vec_id", "label", idx.alias("predicted"), F.element_at(names, idx + 1).alias("predicted_name"),
                    rnd(F.array_max("probs"), 6).alias("confidence"),
                    rnd(F.try_element_at(pm, F.lit("class 1")), 6).alias("p_second"),
                    rnd(F.try_element_at(pm, F.concat(F.lit("class "), (F.size("probs") - 1).cast("string"))), 6).alias("p_last"))
