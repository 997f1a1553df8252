"""functions of siftmark."""
