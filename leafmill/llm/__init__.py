"""Operators for preparing text and vectors as training data. Nothing outside this package imports it."""
