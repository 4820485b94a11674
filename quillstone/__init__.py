"""Spark-native document-catalogue analytics."""
