"""Spark-native data operations: query building, de-identification, reshaping, sync and streaming."""
