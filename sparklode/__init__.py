"""Spark-native storage and search of labelled log streams."""
