"""Fixture views and written intermediate tables."""
