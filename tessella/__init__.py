"""Spark-native analytics for set-labelled image collections."""
