"""A Spark-native engine for curating, scoring and generating problem/solution/test-case data."""
