"""Operators for preparing training text and vectors; nothing outside this package imports it."""
