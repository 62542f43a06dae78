"""Operators for training data on texts; nothing outside this package imports it."""
