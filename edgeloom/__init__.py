"""Spark-native engine for edge tables: score, select, combine and evaluate sparse subgraphs."""
