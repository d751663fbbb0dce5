"""A PySpark-native engine for logs and traces in partitioned Parquet."""
