"""Operators on page and corpus text for training data. Nothing outside this folder imports it."""
