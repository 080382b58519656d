"""Spark-native operators for multilingual text corpora and subword vocabularies."""
