"""lodeframe: a Spark-native repository knowledge engine."""

__version__ = "0.1.0"
