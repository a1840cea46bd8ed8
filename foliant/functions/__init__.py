"""Foliant functions."""
