"""Sensor views of the driver tables, each defined twice: as a Spark
DataFrame and as a DuckDB CTE body for the oracle. Both must stay in step.

* ``event_readings`` -- ``events`` as a device reading stream: user_id is the
  device, ``ts, event_id`` the order, ``value`` the signal (NULL injected on
  every 17th event id), ``props.k`` a load percentage, ``event_type`` the
  reported state.
* ``pump_readings`` -- ``lineitem`` rescaled to pump sensors
  (flow, head, power, vibration) with ``l_returnflag`` as the pump state.
  The low-cardinality source columns give natural duplicate rows and values
  on and beyond the rule bounds.
* ``leak_readings`` -- ``lineitem`` rescaled to compressor readings.
* ``shearer_readings`` / ``temperature_readings`` -- ``lineitem`` rescaled to
  the shearer and temperature-model sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_table

# ---------------------------------------------------------------- events


def event_readings(spark: SparkSession, sf: str) -> DataFrame:
    return event_readings_from(read_table(spark, sf, "events"))


def event_readings_from(e: DataFrame) -> DataFrame:
    """The reading view over an ``events``-shaped batch or stream."""
    sig = F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("device_id"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("state"), sig.alias("signal"),
        (F.lit(40.0) + sig / 10.0).alias("temperature"),
        F.sqrt(sig).alias("ripple"),
        (k / 100.0).alias("load_factor"))


EVENT_READINGS_SQL = """
  SELECT user_id AS device_id, ts, event_id AS seq, event_type AS state, sig AS signal,
         40.0 + sig / 10.0 AS temperature, sqrt(sig) AS ripple, k / 100.0 AS load_factor
  FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS sig,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events)
"""

# ---------------------------------------------------------------- lineitem


def pump_readings(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    state = (F.when((F.col("l_linestatus") != "O") & (F.col("l_returnflag") == "R"), "blocked")
              .when(F.col("l_returnflag") == "A", "normal")
              .when(F.col("l_returnflag") == "N", "wear")
              .when(F.col("l_returnflag") == "R", "cavitation")
              .otherwise("unknown"))
    flow = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(
        F.lit(50.0) + F.lit(2.0) * F.col("l_quantity"))
    return li.select(
        flow.alias("flow"),
        (F.lit(40.0) + F.lit(200.0) * F.col("l_discount")).alias("head"),
        (F.lit(250.0) * F.col("l_tax") - F.lit(5.0)).alias("power"),
        ((F.col("l_quantity") - F.lit(1.0)) / F.lit(4.5)).alias("vibration"),
        state.alias("state"))


PUMP_READINGS_SQL = """
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE 50.0 + 2.0 * l_quantity END AS flow,
         40.0 + 200.0 * l_discount AS head,
         250.0 * l_tax - 5.0 AS power,
         (l_quantity - 1.0) / 4.5 AS vibration,
         CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN 'blocked'
              WHEN l_returnflag = 'A' THEN 'normal' WHEN l_returnflag = 'N' THEN 'wear'
              WHEN l_returnflag = 'R' THEN 'cavitation' ELSE 'unknown' END AS state
  FROM lineitem
"""


def leak_readings(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.lit(0.4) + F.lit(5.0) * F.col("l_discount")).alias("pressure"),
        (F.lit(400.0) + F.col("l_extendedprice") / F.lit(500.0)).alias("supply_flow"),
        (F.lit(400.0) + F.col("l_extendedprice") / F.lit(500.0)
         - F.lit(10.0) * F.col("l_quantity") * F.col("l_tax")).alias("demand_flow"),
        F.when(F.col("l_returnflag") == "R", "leak").otherwise("normal").alias("state"))


LEAK_READINGS_SQL = """
  SELECT l_orderkey, l_linenumber,
         0.4 + 5.0 * l_discount AS pressure,
         400.0 + l_extendedprice / 500.0 AS supply_flow,
         400.0 + l_extendedprice / 500.0 - 10.0 * l_quantity * l_tax AS demand_flow,
         CASE WHEN l_returnflag = 'R' THEN 'leak' ELSE 'normal' END AS state
  FROM lineitem
"""


def shearer_readings(spark: SparkSession, sf: str) -> DataFrame:
    return shearer_readings_from(read_table(spark, sf, "lineitem"))


def shearer_readings_from(li: DataFrame) -> DataFrame:
    """The shearer view over a ``lineitem``-shaped batch or stream."""
    return li.select(
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.col("l_quantity"), F.col("l_extendedprice"),
        (F.col("l_quantity") / F.lit(4.0)).alias("vibration"),
        (F.lit(60.0) + F.lit(400.0) * F.col("l_discount")).alias("temperature"),
        (F.col("l_extendedprice") / F.lit(400.0)).alias("current"),
        (F.lit(10.0) + F.lit(100.0) * F.col("l_tax")).alias("pressure"),
        (F.lit(40.0) + F.lit(6.0) * F.col("l_linenumber")
         + F.col("l_partkey") % F.lit(10)).cast("double").alias("oil_quality"))


SHEARER_READINGS_SQL = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_quantity / 4.0 AS vibration,
         60.0 + 400.0 * l_discount AS temperature,
         l_extendedprice / 400.0 AS current,
         10.0 + 100.0 * l_tax AS pressure,
         CAST(40.0 + 6.0 * l_linenumber + l_partkey % 10 AS DOUBLE) AS oil_quality
  FROM lineitem
"""


def temperature_readings(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.lit(20.0) + F.col("l_quantity")).alias("temp_current"),
        (F.lit(1.0) + F.lit(80.0) * F.col("l_discount")).alias("vibration_x"),
        (F.lit(1.0) + F.lit(80.0) * F.col("l_tax")).alias("vibration_y"),
        (F.lit(1.0) + F.col("l_linenumber").cast("double")).alias("vibration_z"),
        (F.col("l_extendedprice") / F.lit(8000.0)).alias("current"),
        (F.lit(220.0) + F.col("l_partkey") % F.lit(20)).cast("double").alias("voltage"),
        (F.lit(90.0) + F.col("l_suppkey") % F.lit(20)).cast("double").alias("pressure"),
        (F.lit(30.0) + F.col("l_orderkey") % F.lit(40)).cast("double").alias("humidity"))


TEMPERATURE_READINGS_SQL = """
  SELECT l_orderkey, l_linenumber,
         20.0 + l_quantity AS temp_current,
         1.0 + 80.0 * l_discount AS vibration_x,
         1.0 + 80.0 * l_tax AS vibration_y,
         1.0 + CAST(l_linenumber AS DOUBLE) AS vibration_z,
         l_extendedprice / 8000.0 AS current,
         CAST(220.0 + l_partkey % 20 AS DOUBLE) AS voltage,
         CAST(90.0 + l_suppkey % 20 AS DOUBLE) AS pressure,
         CAST(30.0 + l_orderkey % 40 AS DOUBLE) AS humidity
  FROM lineitem
"""
