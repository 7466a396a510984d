"""Readers and the shared scratch area."""
