"""A PySpark-native engine for genome annotations: load, verify, query, export."""
