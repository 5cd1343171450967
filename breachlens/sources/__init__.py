"""Scans of feeds, lists and snapshots."""
