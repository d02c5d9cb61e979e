"""Spark-native analytics over evidence: articles, series, findings and the texts built on them."""
