"""Spark-native detection, correlation and threat-intelligence analytics."""

__version__ = "0.1.0"
