"""Telemetry analytics on Spark: metrics, traces and logs as DataFrames, a compact query language over them."""
