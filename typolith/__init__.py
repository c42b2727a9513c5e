"""Spark-native analytics engine for entity x period x category panels."""
