"""Spark-native graph, mesh and sparse-matrix analytics."""
