"""Operators for preparing training corpora at cluster scale; nothing outside imports this package."""
