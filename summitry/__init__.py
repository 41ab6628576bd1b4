"""Density-peaks clustering and similarity analytics as Spark DataFrame plans."""
