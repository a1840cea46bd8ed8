"""Foliant plans."""
