"""Whole plans: the clustering model, the command line, the registered queries."""
