"""Training-data operators: language id, url filters, piece lattices, exact
top-k search, decontamination, token counts, set-similarity joins, toxicity,
token-id files and sharding.  Nothing else in the library imports this package.
"""
