"""Operators for training-data corpora and their record matching. Nothing outside this package imports it."""
