"""ipquarry: a PySpark-native index and query engine for network logs."""

__version__ = "0.1.0"
