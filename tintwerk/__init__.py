"""A Spark-native engine that finds, links and redacts personal data in large document collections."""
