"""Spark-native analytics over document corpora and retrieval workloads."""
