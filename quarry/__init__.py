"""Spark-native engine for interchange pools, rule overlays, retrieval and gate sessions."""
