"""A Spark-native engine for market-bar analytics."""
