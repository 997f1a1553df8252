"""sources of siftmark."""
