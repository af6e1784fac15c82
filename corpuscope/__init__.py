"""Corpuscope: a Spark-native semantic-search and soft-clustering engine for text corpora."""
