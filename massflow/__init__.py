"""Distributional analytics of time series on Spark."""
