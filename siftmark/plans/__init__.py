"""plans of siftmark."""
