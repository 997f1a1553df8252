"""streaming of siftmark."""
