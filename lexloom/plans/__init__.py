"""Queries and their SQL equivalents over the test tables."""
