"""Spark-native engine for auditing machine-extracted records against a time series."""
