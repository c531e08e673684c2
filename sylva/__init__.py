"""Spark-native analytics and retrieval over hierarchical documents."""
