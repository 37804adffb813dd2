"""Spark-native analytics: relational, text, similarity, recommendation, graph, feature and streaming operators."""
