"""PySpark-native retrieval-evaluation analytics: vector search, metrics, statistics, corpus and cost operators."""
