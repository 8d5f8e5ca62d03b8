"""Structured Streaming twins of the stateless and keyed operators."""
