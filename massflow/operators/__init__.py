"""Relational and iterative operators on price, return and window tables."""
