"""Structured Streaming over the same projections."""
