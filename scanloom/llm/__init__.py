"""Operators for texts and code as training data."""
