"""Probing a built index with records that arrive as a stream."""
