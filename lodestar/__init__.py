"""lodestar: a Spark-native engine for evidence retrieval and large-scale text processing."""
