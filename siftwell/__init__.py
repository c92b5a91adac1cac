"""A Spark-native engine for retrieval, its evaluation and corpus preparation."""
