"""A Spark-native analytics engine for text and code corpora."""
