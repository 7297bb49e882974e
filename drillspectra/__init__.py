"""Mineral mapping of drill-core hyperspectral scans as Spark dataframes."""

__version__ = "0.1.0"
