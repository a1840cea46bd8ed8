"""Foliant operators."""
