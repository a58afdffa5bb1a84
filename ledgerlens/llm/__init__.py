"""Operators that prepare training text. Nothing else in the library imports this package."""
