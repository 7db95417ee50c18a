"""evalspark: a Spark-native engine for agent-evaluation data."""

__version__ = "0.1.0"
