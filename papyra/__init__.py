"""A Spark-native engine for searching and structuring collections of documents."""
