"""Imports fed by Structured Streaming."""
