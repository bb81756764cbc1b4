"""Operators for training-data preparation. Nothing outside this folder imports it."""
