"""moru - a Spark-native engine that prepares corpora for language models."""

__version__ = "0.1.0"
