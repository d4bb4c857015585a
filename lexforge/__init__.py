"""lexforge: a Spark-native engine for searching, auditing and preparing text corpora."""

__version__ = "0.3.0"
