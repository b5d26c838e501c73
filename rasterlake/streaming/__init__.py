"""rasterlake streaming."""
