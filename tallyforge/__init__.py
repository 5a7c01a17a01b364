"""Spark-native analytics for language-model evaluation runs."""
