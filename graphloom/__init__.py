"""A Spark-native engine for software-architecture graphs."""
