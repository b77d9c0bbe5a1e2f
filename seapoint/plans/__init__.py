"""The joins that every reading shares: box-and-time match, and request completion."""
