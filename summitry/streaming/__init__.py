"""Assignment of arriving points to a fitted model."""
