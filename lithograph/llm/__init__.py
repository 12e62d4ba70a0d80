"""Operators for text and embeddings of large training corpora."""
