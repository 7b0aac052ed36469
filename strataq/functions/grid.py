"""Integer grid geometry and scalar conversions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a chunk along each axis, and the shift that gives a chunk's key.
CHUNK, CHUNK_BITS = 32, 5
AXES = ("x", "y", "z")
#: The corners of a dual cube in the order of the bits of its case number.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
#: Largest code of a 32-bit normalised integer.
UNORM_MAX = 4294967295
#: Doubles at or beyond this magnitude round to an infinite float.
FLOAT_LIMIT = 3.4028235677973366e38


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_key(*coords: str | Column) -> list[Column]:
    """The chunk keys cx, cy, cz of voxel coordinates."""
    return [F.shiftright(col(c), CHUNK_BITS).alias(f"c{a}") for c, a in zip(coords or AXES, AXES, strict=True)]


def local_index(x="x", y="y", z="z") -> Column:
    """A voxel's index in its chunk, x fastest."""
    lx, ly, lz = (col(c).bitwiseAND(F.lit(CHUNK - 1)) for c in (x, y, z))
    return lx + CHUNK * ly + CHUNK * CHUNK * lz


def linear_index(nx: int, ny: int, x="x", y="y", z="z") -> Column:
    return col(x) + nx * (col(y) + ny * col(z))


def from_linear(i: Column, nx: int, ny: int) -> list[Column]:
    """x, y, z of an index with x fastest."""
    return [(i % nx).alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z")]


def in_box(lo, hi, coords=AXES) -> Column:
    """Whether a voxel lies in the half-open box [lo, hi)."""
    return reduce(Column.__and__, [(col(c) >= a) & (col(c) < b) for c, a, b in zip(coords, lo, hi, strict=True)])


def box_in_chunks(lo, hi, coords=("cx", "cy", "cz")) -> Column:
    """A predicate on chunk keys that every voxel of the box meets; it prunes files and row groups sorted by chunk."""
    return reduce(Column.__and__, [col(c).between(a >> CHUNK_BITS, (b - 1) >> CHUNK_BITS) for c, a, b in zip(coords, lo, hi, strict=True)])


def intersection(a_lo, a_hi, b_lo, b_hi) -> tuple[list[Column], list[Column]]:
    """Corners of the common part of two half-open boxes; empty where a low corner isn't below the high one."""
    return [F.greatest(col(p), col(q)) for p, q in zip(a_lo, b_lo, strict=True)], [F.least(col(p), col(q)) for p, q in zip(a_hi, b_hi, strict=True)]


def extent(lo, hi) -> list[Column]:
    return [F.greatest(col(h) - col(a), F.lit(0)) for a, h in zip(lo, hi, strict=True)]


def volume(lo, hi) -> Column:
    return reduce(Column.__mul__, [e.cast("long") for e in extent(lo, hi)])


def floor_div(c: Column, r: int | Column) -> Column:
    return F.floor(c / r).cast("int")


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def representable(v: Column, as_float: bool) -> Column:
    """Whether a value is finite, and stays so as a float if it is to become one. Null isn't."""
    ok = finite(v) & (F.abs(v) < FLOAT_LIMIT) if as_float else finite(v)
    return F.coalesce(ok, F.lit(False))


def sanitised(v: Column, as_float: bool = True) -> Column:
    """The value in its target type, 0 where it can't be represented."""
    out = F.when(representable(v, as_float), v).otherwise(F.lit(0.0))
    return out.cast("float") if as_float else out.cast("double")


def unorm_code(v: Column, low: float, high: float) -> Column:
    """The 32-bit normalised code of a value, clamped, rounded half up."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return F.floor(part * float(UNORM_MAX) + 0.5).cast("long")


def unorm_value(code: Column) -> Column:
    """The normalised value of a code, in [0, 1]."""
    return code / float(UNORM_MAX)


def unorm16(v: Column, low: float, high: float) -> Column:
    """A value clamped to [low, high], as a 16-bit normalised code."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return F.floor(part * 65535.0 + 0.5).cast("int")


def cell_centre(c: Column, origin: float | Column, size: float | Column) -> Column:
    """The physical centre of a level-local cell along one axis."""
    return (F.lit(origin) if not isinstance(origin, Column) else origin) + (c + 0.5) * size


def packed_id(level: Column, x: Column, y: Column, z: Column, kind: Column) -> Column:
    """One long from a level (6 bits), a voxel (18 bits for each axis) and a kind (2 bits): ids without a global count."""
    as_long = lambda c: c.cast("long")
    return F.shiftleft(as_long(level), 56).bitwiseOR(F.shiftleft(as_long(z), 38)).bitwiseOR(F.shiftleft(as_long(y), 20)).bitwiseOR(F.shiftleft(as_long(x), 2)).bitwiseOR(as_long(kind))
