"""Graph construction, density peaks, vector quantisation, validity indices, top-k."""
