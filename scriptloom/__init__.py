"""Spark-native analytics over timed, model-produced media transcripts."""
