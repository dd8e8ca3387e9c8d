"""Spark-native analytics over style-sheet corpora and document collections."""
