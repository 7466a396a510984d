"""Composed queries and their registration."""
