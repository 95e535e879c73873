"""Spark-native analytics over event tapes, minute bars and corpus tables."""
