"""Corpus matching and training-data preparation on Spark."""
