"""PySpark-native engine for parallel-text corpora."""
