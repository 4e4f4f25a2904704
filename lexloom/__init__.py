"""Clause analytics on Spark DataFrames: retrieval, segmentation, workflow and training-data operators."""
