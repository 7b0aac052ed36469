"""Relational operators over cells: level, x, y, z (level-local) and value columns. Absence is no row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import grid as G

XYZ = ["x", "y", "z"]


def stats(cells: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """count, nan_count, min and max by group; NaN counts but is no minimum or maximum, which are null if nothing else is there."""
    v = F.col(value)
    real = F.when(~F.isnan(v), v)
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.isnan(v).cast("long")), F.lit(0)).alias("nan_count"), F.min(real).alias("vmin"), F.max(real).alias("vmax"))


def box_scan(cells: DataFrame, lo, hi) -> DataFrame:
    return cells.where(G.in_box(lo, hi))


def any_in_boxes(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """boxes (box_id, lx, ly, lz, hx, hy, hz) that hold a voxel: boxes are dealt to the chunks they meet, so it is an equi join."""
    parts = boxes
    for a in "xyz":
        parts = parts.withColumn(f"c{a}", F.explode(F.sequence(F.shiftright(f"l{a}", G.CHUNK_BITS), F.shiftright(F.col(f"h{a}") - 1, G.CHUNK_BITS))))
    keyed = cells.select(*XYZ, *G.chunk_key())
    inside = G.in_box([F.col("lx"), F.col("ly"), F.col("lz")], [F.col("hx"), F.col("hy"), F.col("hz")])
    return parts.join(keyed, ["cx", "cy", "cz"]).where(inside).select(*boxes.columns).distinct()


def union_replace(dst: DataFrame, src: DataFrame, lo, hi, value: str = "v") -> DataFrame:
    """x, y, z, value: dst with src's voxels written over it, those of src inside the bounds [lo, hi) only."""
    s = src.where(G.in_box(lo, hi)).select(*XYZ, F.col(value).alias("s"))
    return dst.select(*XYZ, F.col(value).alias("d")).join(s, XYZ, "full_outer").select(*XYZ, F.coalesce("s", "d").alias(value))


def last_writer(writes: DataFrame, order: str, value: str = "v") -> DataFrame:
    """One value for each voxel: that of the greatest order; an aggregate, so that overlaps are combined before the shuffle."""
    return writes.groupBy(*XYZ).agg(F.max_by(value, order).alias(value))


def box_cells(spark, lo, hi, value: Column | None = None) -> DataFrame:
    """All voxels of a box, made by nested sequences."""
    df = spark.range(lo[2], hi[2]).select(F.col("id").cast("int").alias("z"))
    df = df.select(F.explode(F.sequence(F.lit(lo[0]), F.lit(hi[0] - 1))).alias("x"), F.lit(0).alias("u"), "z").select("x", F.explode(F.sequence(F.lit(lo[1]), F.lit(hi[1] - 1))).alias("y"), "z")
    return df if value is None else df.withColumn("v", value)


def fill_box(cells: DataFrame, lo, hi, bounds_lo, bounds_hi, value: float) -> DataFrame:
    """cells with the box, clipped to the bounds, filled with one value."""
    lo, hi = [max(a, b) for a, b in zip(lo, bounds_lo, strict=True)], [min(a, b) for a, b in zip(hi, bounds_hi, strict=True)]
    rest = cells.where(~G.in_box(lo, hi)).select(*XYZ, "v")
    if any(a >= b for a, b in zip(lo, hi, strict=True)):
        return cells.select(*XYZ, "v")
    kind = cells.schema["v"].dataType
    return rest.unionByName(box_cells(cells.sparkSession, lo, hi, F.lit(value).cast(kind)))


def clear_box(cells: DataFrame, lo, hi) -> DataFrame:
    return cells.where(~G.in_box(lo, hi))


def block_cells(blocks: DataFrame) -> DataFrame:
    """x, y, z, v of dense blocks (lx, ly, lz, nx, ny, nz, values), x fastest; a block whose values aren't as many as its cells is
    an error."""
    fits = F.size("values") == F.col("nx") * F.col("ny") * F.col("nz")
    checked = F.when(fits, F.col("values")).otherwise(F.raise_error(F.lit("a block's values don't fill it")).cast(blocks.schema["values"].dataType))
    at = blocks.select("lx", "ly", "lz", "nx", "ny", F.posexplode(checked).alias("i", "v"))
    x, y, z = G.from_linear(F.col("i"), F.col("nx"), F.col("ny"))
    return at.select((F.col("lx") + x).cast("int").alias("x"), (F.col("ly") + y).cast("int").alias("y"), (F.col("lz") + z).cast("int").alias("z"), "v")


def write_blocks(cells: DataFrame, blocks: DataFrame, bounds_lo, bounds_hi) -> DataFrame:
    """cells overwritten by dense blocks that share no cell (see block_cells), clipped to the bounds."""
    block = block_cells(blocks)
    return union_replace(cells, block.withColumn("v", F.col("v").cast(cells.schema["v"].dataType)), bounds_lo, bounds_hi)


def write_block(cells: DataFrame, lo, shape, values: list[float], bounds_lo, bounds_hi) -> DataFrame:
    """write_blocks() with one block given as a list."""
    if len(values) != shape[0] * shape[1] * shape[2]:
        raise ValueError(f"{len(values)} values for a block of {shape[0] * shape[1] * shape[2]} cells")
    block = cells.sparkSession.createDataFrame([(*lo, *shape, [float(v) for v in values])], "lx int, ly int, lz int, nx int, ny int, nz int, values array<double>")
    return write_blocks(cells, block, bounds_lo, bounds_hi)


def map_chunks(cells: DataFrame, function, schema: str, value: str = "v") -> DataFrame:
    """function(pandas frame) for each chunk's cells (level, cx, cy, cz, i, value; 32768 rows at most, sorted by i)."""
    rows = cells.select("level", *G.chunk_key(), G.local_index().alias("i"), F.col(value))
    return rows.groupBy("level", "cx", "cy", "cz").applyInPandas(lambda f: function(f.sort_values("i")), schema)


def chunk_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("level", *G.chunk_key()).agg(F.count("*").alias("n"))


def chunk_uniformity(cells: DataFrame, value: str = "v") -> DataFrame:
    """level, cx, cy, cz, n, uniform: all values equal (NaN equals nothing), and full: no voxel is absent."""
    v = F.col(value)
    same = (F.min(v) == F.max(v)) & (F.max(F.isnan(v).cast("int")) == 0)
    return cells.groupBy("level", *G.chunk_key()).agg(F.count("*").alias("n"), same.alias("uniform"), (F.count("*") == G.CHUNK**3).alias("full"))


def chunk_ranges(cells: DataFrame, cubes: DataFrame | None = None, value: str = "v") -> DataFrame:
    """level, cx, cy, cz, vmin, vmax over each chunk's voxels and one more voxel beyond its upper sides.

    A voxel on a chunk's lower side belongs to the neighbour's halo too: it goes to at most eight chunks. With cubes (level,
    ax, ay, az), only chunks that hold an anchor are given."""
    keys = cells.select("level", *XYZ, F.col(value).alias("v"))
    for a in "xyz":
        here = F.shiftright(a, G.CHUNK_BITS)
        halo = (F.col(a).bitwiseAND(F.lit(G.CHUNK - 1)) == 0) & (F.col(a) > 0)
        keys = keys.withColumn(f"c{a}", F.explode(F.when(halo, F.array(here - 1, here)).otherwise(F.array(here))))
    v = F.when(~F.isnan("v"), F.col("v"))
    out = keys.groupBy("level", "cx", "cy", "cz").agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.max(F.struct((F.shiftright("x", 5) == F.col("cx")) & (F.shiftright("y", 5) == F.col("cy")) & (F.shiftright("z", 5) == F.col("cz")))["col1"]).alias("own"))
    out = out.where("own").drop("own")
    if cubes is None:
        return out
    held = cubes.select("level", *G.chunk_key("ax", "ay", "az")).distinct()
    return out.join(held, ["level", "cx", "cy", "cz"], "left_semi")


def crossing(ranges: DataFrame, iso: float) -> DataFrame:
    """Chunks whose range has the isovalue: vmin <= iso < vmax."""
    return ranges.where((F.col("vmin") <= iso) & (F.col("vmax") > iso))


def corner_value(k: int, value: str = "v") -> Column:
    return F.max(F.when(F.col("k") == k, F.col(value)))


def cubes(cells: DataFrame, value: str = "v", corners: bool = True) -> DataFrame:
    """level, ax, ay, az [, v0..v7] of the dual cubes all of whose corners are there, named by their lowest corner.

    Each voxel names the eight cubes it is a corner of; counts and corner values are combined before the shuffle, where the
    cubes inside a task's patches come down to one row each.
    """
    named = cells.select("level", *XYZ, F.col(value).alias("v"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(d).alias(f"d{a}") for d, a in zip(c, "xyz", strict=True))) for k, c in enumerate(G.CORNERS)))).alias("o"))
    named = named.select("level", *((F.col(a) - F.col(f"o.d{a}")).alias(f"a{a}") for a in "xyz"), F.col("o.k").alias("k"), "v")
    values = [corner_value(k).alias(f"v{k}") for k in range(8)] if corners else []
    return named.groupBy("level", "ax", "ay", "az").agg(F.count("*").alias("__n"), *values).where("__n = 8").drop("__n")


def cubes_by_chunk(cells: DataFrame, values: list[str], corners: bool = True) -> DataFrame:
    """cubes() of cells that are there once each: a chunk's cells, and those beyond its upper sides that
    its cubes need, go to one task, so every cell is shuffled about once instead of eight cubes of it. One value column gives
    v0..v7; corners=False gives only level, ax, ay, az."""
    keys = cells.select("level", *XYZ, *values)
    for a in "xyz":
        here = F.shiftright(a, G.CHUNK_BITS)
        keys = keys.withColumn(f"c{a}", F.explode(F.when(F.col(a).bitwiseAND(F.lit(G.CHUNK - 1)) == 0, F.array(here - 1, here)).otherwise(F.array(here))))
    names = [f"v{k}" for k in range(8)] if corners else []

    def run(chunk: pa.Table) -> pa.Table:
        first = [chunk.column(f"c{a}")[0].as_py() * G.CHUNK for a in "xyz"]
        at = [chunk.column(a).to_numpy() - f for a, f in zip(XYZ, first, strict=True)]
        row = np.full((G.CHUNK + 1,) * 3, -1)
        row[at[2], at[1], at[0]] = np.arange(chunk.num_rows)
        n = G.CHUNK
        ends = np.stack([row[dz : dz + n, dy : dy + n, dx : dx + n] for dx, dy, dz in G.CORNERS])
        z, y, x = np.nonzero((ends >= 0).all(0))
        out = {"level": np.full(len(x), chunk.column("level")[0].as_py(), np.int32), **{f"a{a}": (c + f).astype(np.int32) for a, c, f in zip("xyz", (x, y, z), first, strict=True)}}
        for k, name in enumerate(names):
            out[name] = chunk.column(values[0]).take(pa.array(ends[k, z, y, x]))
        return pa.table(out)

    kind = cells.schema[values[0]].dataType.simpleString() if corners else ""
    schema = "level int, ax int, ay int, az int" + "".join(f", {name} {kind}" for name in names)
    return keys.groupBy("level", "cx", "cy", "cz").applyInArrow(run, schema)


def case_index(iso: float) -> Column:
    """The sign pattern of a cube: bit k is set where corner k is above the isovalue."""
    out = F.lit(0)
    for k in range(8):
        out = out + F.when(F.col(f"v{k}") > iso, 1 << k).otherwise(0)
    return out


def gradient(size=(1.0, 1.0, 1.0)) -> list[Column]:
    """gx, gy, gz: the mean of a cube's four differences along each axis, by the cell size."""
    v = [F.col(f"v{k}").cast("double") for k in range(8)]
    up = [[k for k, c in enumerate(G.CORNERS) if c[a]] for a in range(3)]
    out = []
    for a, s in enumerate(size):
        high = sum((v[k] for k in up[a][1:]), v[up[a][0]])
        low_k = [k for k in range(8) if k not in up[a]]
        low = sum((v[k] for k in low_k[1:]), v[low_k[0]])
        out.append(((high - low) / (4.0 * s)).alias(f"g{'xyz'[a]}"))
    return out


def covered_by(fine: DataFrame, ratio=(2, 2, 2), shift=(0, 0, 0)) -> DataFrame:
    """x, y, z of the coarse voxels that some fine voxel lies in; fine = coarse * ratio + shift."""
    return fine.select(*(G.floor_div(F.col(c) - t, r).alias(c) for c, r, t in zip(XYZ, ratio, shift, strict=True))).distinct()


def mask_any_cover(coarse: DataFrame, fine: DataFrame, ratio=(2, 2, 2), shift=(0, 0, 0), coords=tuple(XYZ)) -> DataFrame:
    """The coarse rows whose voxel no fine voxel lies in. The scaled key makes it an equi join."""
    hidden = covered_by(fine, ratio, shift).toDF(*coords)
    return coarse.join(hidden, list(coords), "left_anti")


def mask_full_cover(coarse: DataFrame, fine: DataFrame, axis: str, ratio=(2, 2, 2), shift=(0, 0, 0), fine_hi=(1 << 30,) * 3) -> DataFrame:
    """The coarse cells of a slice, without those every one of whose columns of fine cells across the plane has an active
    one, if the fine box lies inside the fine level's bounds."""
    across = [i for i, a in enumerate(XYZ) if a != axis]
    place = [F.col(c) - t for c, t in zip(XYZ, shift, strict=True)]
    key = [G.floor_div(place[i], ratio[i]).alias(XYZ[i]) for i in range(3)]
    column = [F.pmod(place[i], F.lit(ratio[i])).cast("int") for i in across]
    full = ratio[across[0]] * ratio[across[1]]
    seen = fine.select(*key, (column[0] * ratio[across[1]] + column[1]).alias("__column")).distinct()
    seen = seen.groupBy(*XYZ).agg(F.count("*").alias("__n")).where(F.col("__n") == full)
    for c, r, t, h in zip(XYZ, ratio, shift, fine_hi, strict=True):
        seen = seen.where((F.col(c) * r + t >= 0) & ((F.col(c) + 1) * r + t <= h))
    return coarse.join(seen.select(*XYZ), XYZ, "left_anti")


#: From a coarse level to the next finer one, unless told otherwise: ratio and shift.
STEP = ((2, 2, 2), (0, 0, 0))


def active_cubes(by_level: dict[int, DataFrame], samples: dict[int, DataFrame], iso: float, steps: dict[int, tuple] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Cubes with corners of all levels that may hold a surface: complete, their anchor not under the next finer selected
    level, and in a chunk whose range has the isovalue (ranges are those before masking). steps: by coarse level, (ratio,
    shift) with fine = coarse * ratio + shift. ranges: all levels' chunk ranges, where they are known already."""
    out, levels = None, sorted(by_level)
    for i, level in enumerate(levels):
        own = by_level[level]
        left = own
        if i + 1 < len(levels) and levels[i + 1] == level + 1:
            left = mask_any_cover(own, samples[level + 1], *(steps or {}).get(level, STEP), ("ax", "ay", "az"))
        chunks = crossing(chunk_ranges(samples[level], own) if ranges is None else ranges.where(F.col("level") == level), iso)
        keyed = left.withColumns(dict(zip(("cx", "cy", "cz"), G.chunk_key("ax", "ay", "az"), strict=True)))
        left = keyed.join(chunks, ["level", "cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")
        out = left if out is None else out.unionByName(left)
    return out

