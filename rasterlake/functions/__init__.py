"""rasterlake functions."""
