"""lodepath: a PySpark-native engine for corpora of semi-structured records."""

__version__ = "0.1.0"
