"""Lattices and queries over the driver tables."""
