"""Column functions on text, dates and JSON."""
