"""Operators over cells, cubes, slices, surfaces, meshes and chunks."""
