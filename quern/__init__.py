"""quern: a PySpark-native engine for retrieval, history, telemetry and training-data work on tables."""

__version__ = "0.1.0"
