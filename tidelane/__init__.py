"""Spark-native storage and querying of half-open genomic intervals."""
