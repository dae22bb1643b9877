"""Spark-native retrieval, report analytics and corpus preparation."""
