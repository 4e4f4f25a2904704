"""Readers, renderers and writers."""
