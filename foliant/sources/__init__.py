"""Foliant sources."""
