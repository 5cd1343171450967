"""Whole imports and the tables they maintain."""
