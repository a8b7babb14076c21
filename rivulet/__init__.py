"""Sensor-network time series and flood analytics on Spark DataFrames."""
