"""Structured Streaming forms of the stateless and aggregating operators."""
