"""Sequence-based anomaly detection for sensor time series, on PySpark DataFrames."""

__version__ = "0.1.0"
