"""Fixed schemas per job (no inference on production paths) and the
name alias map that bridges CamelCase training columns and snake_case
sample files."""

from __future__ import annotations

from pyspark.sql import types as T


def doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType(), True) for n in names])


# Sample reading files (all doubles, one header row).
TEMPERATURE_SAMPLES = doubles("temp_current", "vibration_x", "vibration_y", "vibration_z",
                              "current", "voltage", "pressure", "humidity")
PUMP_SAMPLES = doubles("flow", "head", "power", "vibration")
LEAK_SAMPLES = doubles("pressure", "supply_flow", "demand_flow", "flow_diff", "flow_ratio")
BELT_FAULT_SAMPLES = doubles("current", "speed_diff", "vibration_motor", "temperature_bearing",
                             "current_std")
BELT_SLIP_SAMPLES = doubles("current", "speed_diff", "vibration", "temperature")
INVERTER_WINDOW_SAMPLES = doubles("mean_ripple", "std_ripple", "mean_temp", "temp_rise",
                                  "mean_load", "temp_range")

# Training tables (files are not shipped by the reference; schemas known).
INVERTER_RAW = T.StructType(
    [T.StructField("time", T.LongType(), True)]
    + doubles("load_factor", "temperature", "ripple", "label_life", "label_thermal").fields)
PUMP_TRAIN = T.StructType(
    doubles("Flow", "Head", "Power", "Vibration", "Efficiency_Index", "Specific_Power").fields
    + [T.StructField("label", T.StringType(), True)])
LEAK_TRAIN = T.StructType(
    doubles("Pressure", "SupplyFlow", "DemandFlow", "FlowDiff", "FlowRatio").fields
    + [T.StructField("label", T.StringType(), True)])
IGBT_TRAIN = doubles("current", "frequency", "ambient_temp", "temp_rate", "load_factor", "target_temp")
SHEARER = T.StructType(doubles("vibration", "temperature", "current", "pressure", "oil_quality").fields
                       + [T.StructField("fault", T.IntegerType(), True)])
BELT_FAULT_RAW = T.StructType(
    doubles("current", "speed_head", "speed_tail", "vibration_motor", "temperature_bearing",
            "slip_rate").fields + [T.StructField("fault", T.IntegerType(), True)])
BELT_SLIP = T.StructType(doubles("current", "speed_diff", "vibration", "temperature").fields
                         + [T.StructField("label", T.IntegerType(), True)])

# Training column name -> sample-file column name.
ALIASES = {
    "Flow": "flow",
    "Head": "head",
    "Power": "power",
    "Vibration": "vibration",
    "Efficiency_Index": "efficiency_index",
    "Specific_Power": "specific_power",
    "Pressure": "pressure",
    "SupplyFlow": "supply_flow",
    "DemandFlow": "demand_flow",
    "FlowDiff": "flow_diff",
    "FlowRatio": "flow_ratio",
}

# Class names in code order (index = encoded label).
PUMP_CLASSES = ["normal", "wear", "cavitation"]
LEAK_CLASSES = ["normal", "leak"]
BINARY_CLASSES = ["normal", "fault"]

# Feature order per job (the vector contract).
FEATURES = {
    "temperature": ["temp_current", "vibration_x", "vibration_y", "vibration_z",
                    "current", "voltage", "pressure", "humidity"],
    "simple_temperature": ["temp", "vibration_x", "current"],
    "pump": ["flow", "head", "power", "vibration", "efficiency_index", "specific_power"],
    "leak": ["pressure", "supply_flow", "demand_flow", "flow_diff", "flow_ratio"],
    "shearer": ["vibration", "temperature", "current", "pressure", "oil_quality"],
    "belt_fault": ["current", "speed_diff", "vibration_motor", "temperature_bearing", "current_std"],
    "belt_slip": ["current", "speed_diff", "vibration", "temperature"],
    "inverter": ["mean_ripple", "std_ripple", "mean_temp", "temp_rise", "mean_load", "temp_range"],
    "igbt": ["current", "frequency", "ambient_temp", "temp_rate", "load_factor"],
}
