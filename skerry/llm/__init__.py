"""Operators for building training corpora. Nothing else in skerry imports this package."""
