"""Spark-native data operators for tabular and text risk data."""
