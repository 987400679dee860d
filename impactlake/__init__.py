"""A Spark-native engine for vehicle crash-test metadata and general relational analytics."""
