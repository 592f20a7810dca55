"""A Spark-native engine for turning web crawls into quality-filtered text."""
