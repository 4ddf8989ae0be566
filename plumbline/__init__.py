"""Plumbline: a PySpark-native audit and data-processing engine for vector indexes."""

__version__ = "0.1.0"
