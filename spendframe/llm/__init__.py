"""Operators for preparing text corpora as training data."""
