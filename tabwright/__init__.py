"""Spark-native toolkit for price-style regression on wide tables."""

__version__ = "0.1.0"
