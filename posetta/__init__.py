"""Positional analytics on Spark: folds, bit sets, range queries, digests and training-data operators."""
