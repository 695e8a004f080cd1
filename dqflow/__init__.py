"""Spark-native data-quality and medallion engine for claims-style tables."""
