"""rasterlake operators."""
