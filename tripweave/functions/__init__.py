"""Expressions over columns: geography, route sets, names, outcomes."""
