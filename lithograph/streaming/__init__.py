"""Incremental maintenance of the graph, batch by batch or from a stream."""
