"""Spark-native generalized linear models and the analytics around them."""
