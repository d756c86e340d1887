"""Whole jobs: preview and archive runs."""
