"""Repeated runs over files that keep arriving."""
