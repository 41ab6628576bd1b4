"""Column functions: distances, n-grams, vector algebra."""
