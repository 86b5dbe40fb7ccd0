"""DataFrame transforms by subject."""
