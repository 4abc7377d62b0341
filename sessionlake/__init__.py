"""sessionlake: a Spark-native engine for conversational session archives."""

__version__ = "0.1.0"
