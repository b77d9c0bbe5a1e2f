"""Products, request tables and observation tables."""
