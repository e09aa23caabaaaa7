"""Spark-native governed retrieval, governance analytics and corpus tools."""
