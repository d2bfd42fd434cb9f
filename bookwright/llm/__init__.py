"""Operators that prepare collections as training text. Nothing else in the library imports this."""
