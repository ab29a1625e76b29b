"""Operators on the texts of a training corpus; nothing else in the library imports this package."""
