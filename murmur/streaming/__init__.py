"""Incremental forms of the captures."""
