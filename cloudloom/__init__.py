"""A Spark-native engine for scan analytics."""
