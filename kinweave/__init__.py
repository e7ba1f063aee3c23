"""Spark-native record linkage and corpus analytics."""
