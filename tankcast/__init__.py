"""Telemetry forecasting and control operators on Spark DataFrames."""
