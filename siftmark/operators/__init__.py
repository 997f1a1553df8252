"""operators of siftmark."""
