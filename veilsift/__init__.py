"""Spark-native content inspection: HTML, text and image checks as DataFrame operations."""
