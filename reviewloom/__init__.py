"""Spark-native engine for building, curating and scoring code-review datasets."""
