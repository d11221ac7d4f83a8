"""A Spark-native engine for keyed, document-style analytics."""
