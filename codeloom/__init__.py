"""Spark-native analytics over code elements, graphs, vectors, findings and training text."""
