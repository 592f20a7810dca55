"""Operators for the text side of a training-data pipeline (nothing else in the library imports this)."""
