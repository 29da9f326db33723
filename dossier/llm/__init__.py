"""Operators for preparing training data, and their queries over the given tables."""
