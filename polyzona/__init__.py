"""Spark-native analytics over hierarchical, irregular polygon zones."""
