"""A Spark-native engine for document search, its evaluation and the data work around it."""
