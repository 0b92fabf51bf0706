"""Operators on texts for training data; nothing outside of this folder imports it."""
