"""Spark-native analytics over typed code graphs and text corpora."""
