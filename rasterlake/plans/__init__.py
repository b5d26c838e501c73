"""rasterlake plans."""
