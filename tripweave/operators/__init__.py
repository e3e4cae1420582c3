"""Operators over the ridership model."""
