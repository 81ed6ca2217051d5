"""Streaming forms of the rollups."""
