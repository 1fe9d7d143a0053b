"""strataloom: time-series classification and analytics on PySpark."""

__version__ = "0.1.0"
