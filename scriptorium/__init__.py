"""A Spark-native engine for document and knowledge-base analytics."""
