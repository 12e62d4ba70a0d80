"""Readers, writers and merges of the graph's tables."""
