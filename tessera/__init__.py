"""Spark-native analytics over sparse spatial counts, with a training-data corpus toolkit."""
