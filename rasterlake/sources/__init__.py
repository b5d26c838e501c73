"""rasterlake sources."""
