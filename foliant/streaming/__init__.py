"""Foliant streaming."""
