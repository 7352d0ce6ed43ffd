"""Incremental graph building."""
