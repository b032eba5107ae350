"""Operators on names, items and texts for training data; nothing outside imports this package."""
