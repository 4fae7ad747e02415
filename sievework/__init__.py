"""Spark-native text safety analytics: detection, scoring, redaction and audit over DataFrames."""
