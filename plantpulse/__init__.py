"""plantpulse -- Spark-native analytics for equipment sensor data.

Sub-packages: ``sources`` (scans, sinks, schemas), ``functions`` (column
expressions: features, rules, encoding), ``operators`` (DataFrame -> DataFrame
operators: quality, windows, profiles, metrics, joins, splits, models,
alerts), ``streaming`` (Structured Streaming jobs) and ``plans`` (the
registered queries over the driver tables and their SQL oracles).
"""

__version__ = "0.1.0"
