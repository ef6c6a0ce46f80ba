"""Operators for preparing large text and vector corpora. Nothing else in the library imports this package."""
