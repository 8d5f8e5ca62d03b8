"""Operators that prepare text, vectors, urls and conversations for model training."""
