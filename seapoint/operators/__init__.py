"""Readings per product family, and the single steps they are made of."""
