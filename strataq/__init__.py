"""Analytics over block-structured adaptive-mesh volume data, as PySpark DataFrames.

Cells are rows, a level is a partition, a stencil is a grouped explode, masking is an anti join, a mesh is two tables.
"""
