"""Operators on text collections for training data. Nothing outside this package imports it."""
