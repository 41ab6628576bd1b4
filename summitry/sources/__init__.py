"""Readers, writers and generators of vectors, strings, sets, graphs, codebooks and partitions."""
