"""Operators for text collections used as training data."""
