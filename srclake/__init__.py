"""A PySpark-native engine for source-code analytics, retrieval and training-data preparation."""

__version__ = "0.1.0"
