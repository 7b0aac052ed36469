"""Axis-aligned slices as quad meshes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.cells import STEP, XYZ, mask_full_cover

#: For each axis, the four corners of a cell's quad, in the winding of its two triangles.
QUADS = {
    "x": ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)),
    "y": ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
    "z": ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)),
}


def plane_cell(value: float, origin: float, size: float, extent: int) -> int | None:
    """The layer that a plane cuts: one on a face between cells belongs to the lower cell, except at the origin."""
    if not math.isfinite(value):
        raise ValueError("the plane's value must be finite")
    g = (value - origin) / size
    k = math.floor(g)
    if g == k and k > 0:
        k -= 1
    return k if 0 <= k < extent else None


def slice_cells(cells: DataFrame, axis: str, layer: int | None, value: str = "v") -> DataFrame:
    """The present cells of the plane's layer."""
    return cells.where(F.col(axis) == layer if layer is not None else F.lit(False)).where(F.col(value).isNotNull())


def slice_values(cells: DataFrame, axis: str, plane: float, layer: int, origin: float, size: float, values: list[tuple[str, float, float]], active: DataFrame | None = None) -> DataFrame:
    """x, y, z and u0, u1, ... of each active cell (by default all of the layer): each value interpolated at the plane between
    the cell and its neighbour on the plane's side, its own where there is none, then normalised to [0, 1] by (name, low, high)."""
    centre = origin + (layer + 0.5) * size
    side = 1 if plane >= centre else -1
    t = min(1.0, max(0.0, (plane - centre) / (side * size)))
    own = cells.where(F.col(axis) == layer)
    if active is not None:
        own = own.join(active.select(*XYZ), XYZ, "left_semi")
    near = cells.where(F.col(axis) == layer + side).select(*((F.col(a) - side).alias(a) if a == axis else F.col(a) for a in XYZ), *(F.col(v).cast("double").alias(f"n_{v}") for v, _, _ in values))
    joined = own.select(*XYZ, *(F.col(v).cast("double").alias(v) for v, _, _ in values)).join(near, XYZ, "left")
    out = []
    for i, (v, low, high) in enumerate(values):
        at = F.coalesce(F.col(v) + (F.col(f"n_{v}") - F.col(v)) * t, F.col(v))
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - low) / (high - low))).cast("float").alias(f"u{i}"))
    return joined.select(*XYZ, *out)


def slice_mesh(quads: DataFrame, axis: str, plane: float, origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0), flip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, level, px, py, pz, u, v) and faces (fid, level, a, b, c) of the quads (level, x, y, z, u0[, u1]).

    Cells share no vertices: a cell's number along the plane gives its vertices' ids, so nothing is counted or sorted."""
    across = [a for a in XYZ if a != axis]
    cell = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col(across[1]).cast("long"), 28) + F.col(across[0]).cast("long")
    corners = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(d).alias(f"d{a}") for d, a in zip(c, XYZ, strict=True))) for i, c in enumerate(QUADS[axis])))
    second = F.col("u1") if "u1" in quads.columns else F.lit(0.0).cast("float")
    v = quads.select("level", *XYZ, "u0", second.alias("u1"), cell.alias("cell"), F.explode(corners).alias("k"))
    place = [F.lit(plane) if a == axis else F.lit(o) + (F.col(a) + F.col(f"k.d{a}")) * s for a, o, s in zip(XYZ, origin, size, strict=True)]
    vertices = v.select((F.col("cell") * 4 + F.col("k.i")).alias("vid"), "level", *(p.cast("float").alias(f"p{a}") for p, a in zip(place, XYZ, strict=True)), F.col("u0").alias("u"), F.col("u1").alias("v"))
    order = ((0, 2, 1), (0, 3, 2)) if flip else ((0, 1, 2), (0, 2, 3))
    f = quads.select("level", cell.alias("cell"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(c).alias(n) for c, n in zip(t, "abc", strict=True))) for i, t in enumerate(order)))).alias("t"))
    faces = f.select((F.col("cell") * 2 + F.col("t.i")).alias("fid"), "level", *((F.col("cell") * 4 + F.col(f"t.{n}")).alias(n) for n in "abc"))
    return vertices, faces


def slice_of_levels(by_level: dict[int, DataFrame], axis: str, plane: float, geometry: dict[int, tuple], values: list[tuple[str, float, float]], steps: dict[int, tuple] | None = None,
                    level_range: tuple[int, int] | None = None, flip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces (see slice_mesh) of the plane's cells over all selected levels; a coarse cell whose every column of fine
    cells across the plane has one of the next finer selected level shows none.

    by_level: cells (level, x, y, z, values' columns). geometry: by level, (origin, cell size, extent), three numbers each. values:
    one or two, as (column, low, high); the first one's column says which cells are there."""
    if not 1 <= len(values) <= 2 or len({v[0] for v in values}) != len(values):
        raise ValueError("one or two different values are wanted")
    if any(not (math.isfinite(low) and math.isfinite(high) and low < high) for _, low, high in values):
        raise ValueError("a value's bounds must be finite and rising")
    if axis not in XYZ:
        raise ValueError("the axis is x, y or z")
    if level_range is not None and not (min(by_level) <= level_range[0] <= level_range[1] <= max(by_level)):
        raise ValueError("the level range isn't one of the levels given")
    chosen = [k for k in sorted(by_level) if level_range is None or level_range[0] <= k <= level_range[1]]
    a = XYZ.index(axis)
    layers = {k: plane_cell(plane, geometry[k][0][a], geometry[k][1][a], geometry[k][2][a]) for k in chosen}
    vs, fs = None, None
    for k in chosen:
        origin, size, _ = geometry[k]
        active = slice_cells(by_level[k], axis, layers[k], values[0][0])
        if k + 1 in chosen and layers[k + 1] is not None:
            ratio, shift = (steps or {}).get(k, STEP)
            active = mask_full_cover(active, slice_cells(by_level[k + 1], axis, layers[k + 1], values[0][0]), axis, ratio, shift, geometry[k + 1][2])
        quads = slice_values(by_level[k], axis, plane, layers[k] or 0, origin[a], size[a], values, active).withColumn("level", F.lit(k))
        v, f = slice_mesh(quads, axis, plane, origin, size, flip)
        vs, fs = (v, f) if vs is None else (vs.unionByName(v), fs.unionByName(f))
    return vs, fs
