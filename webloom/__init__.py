"""webloom: a Spark-native engine for web-document corpora."""

__version__ = "0.1.0"
