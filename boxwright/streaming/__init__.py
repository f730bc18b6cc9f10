"""Queries over boxes that arrive as a stream."""
