"""A Spark-native engine for transaction-risk analytics."""
