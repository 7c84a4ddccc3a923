"""A Spark-native engine for dimensional time-series rollups."""
