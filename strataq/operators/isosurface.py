"""Isosurfaces: edge vertices relationally, faces by tracing each cube's contours.

A cube's surface follows from its signs and, on ambiguous faces, from the asymptotic decider, which looks at that face's
four values only, so neighbours agree. Contours of the six faces close to loops over the cut edges. A loop of up to seven
edges is a fan, a longer one a fan around an interior vertex; two loops that the interior test finds joined by a tunnel are
stitched to a band. Patterns depend on signs and decisions alone and are made once for each.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import grid as G
from strataq.functions.lineage import checkpointed
from strataq.operators.cells import XYZ, active_cubes
from strataq.operators.cells import cubes as complete

EPSILON = 1e-12
CORNERS = np.array(G.CORNERS)
#: Each cube edge as (low corner, high corner, axis); low is first in the order of x, y, z.
EDGES = [(a, b, int(np.flatnonzero(CORNERS[b] - CORNERS[a])[0])) for a in range(8) for b in range(8) if (d := CORNERS[b] - CORNERS[a]).sum() == 1 and (d >= 0).all()]
EDGE_OF = {frozenset(e[:2]): i for i, e in enumerate(EDGES)}
#: Each face as its four corners in a circle, seen from outside counter-clockwise.
FACES = []
for _axis in range(3):
    for _side in (0, 1):
        _u, _v = [a for a in range(3) if a != _axis]
        _ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        _at = lambda p, axis=_axis, side=_side, u=_u, v=_v: next(i for i, c in enumerate(G.CORNERS) if c[axis] == side and c[u] == p[0] and c[v] == p[1])
        _ids = [_at(p) for p in _ring]
        FACES.append(_ids if (_side == 1) == (_axis != 1) else _ids[::-1])
INTERIOR = 3


def edge_vertices(cells: DataFrame, iso: float, cubes: DataFrame | None = None, value: str = "v", origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0)) -> DataFrame:
    """level, x, y, z, axis, t, px, py, pz: one vertex for each voxel edge that the surface cuts (keyed by its low voxel and its
    axis), on cubes (level, ax, ay, az with corners) or, without them, on all edges between present voxels."""
    if cubes is not None:
        parts = F.array(*(F.struct(*(F.lit(int(c)).alias(f"d{n}") for c, n in zip(CORNERS[a], XYZ, strict=True)), F.lit(axis).alias("axis"), F.col(f"v{a}").cast("double").alias("s"), F.col(f"v{b}").cast("double").alias("e")) for a, b, axis in EDGES))
        cut = cubes.select("level", "ax", "ay", "az", F.explode(parts).alias("e"))
        cut = cut.where((F.col("e.s") > iso) != (F.col("e.e") > iso))
        cut = cut.select("level", *((F.col(f"a{n}") + F.col(f"e.d{n}")).alias(n) for n in XYZ), F.col("e.axis").alias("axis"), F.col("e.s").alias("s"), F.col("e.e").alias("e")).distinct()
    else:
        base = cells.select("level", *XYZ, F.col(value).cast("double").alias("s"))
        cut = None
        for axis, n in enumerate(XYZ):
            high = base.select("level", *((F.col(m) - 1).alias(m) if m == n else F.col(m) for m in XYZ), F.col("s").alias("e"))
            part = base.join(high, ["level", *XYZ]).where((F.col("s") > iso) != (F.col("e") > iso)).withColumn("axis", F.lit(axis))
            cut = part if cut is None else cut.unionByName(part)
    return placed(cut, iso, origin, size)


def placed(cut: DataFrame, iso: float, origin, size) -> DataFrame:
    cut = cut.withColumn("t", along("s", "e", iso))
    place = [F.lit(float(o)) + ((F.col(n) + F.when(F.col("axis") == i, F.col("t")).otherwise(0.0)) + 0.5) * float(d) for i, (n, o, d) in enumerate(zip(XYZ, origin, size, strict=True))]
    return cut.select("level", *XYZ, "axis", "t", *(p.cast("float").alias(f"p{n}") for p, n in zip(place, XYZ, strict=True)))


def edge_samples(vertices: DataFrame, samples: DataFrame, low: float, high: float, value: str = "v", name: str = "u") -> DataFrame:
    """vertices with `name`: a sampled quantity at t between the edge's voxels, as a 16-bit code and back. A voxel without a
    sample is an error, as the reader must not invent values."""
    s = samples.select("level", *XYZ, F.col(value).cast("double").alias("q0"))
    end = samples.select("level", *((F.col(n)).alias(f"e{n}") for n in XYZ), F.col(value).cast("double").alias("q1"))
    v = vertices.join(s, ["level", *XYZ], "left")
    v = v.withColumns({f"e{n}": F.col(n) + (F.col("axis") == i).cast("int") for i, n in enumerate(XYZ)}).join(end, ["level", "ex", "ey", "ez"], "left")
    q = F.col("q0") + (F.col("q1") - F.col("q0")) * F.col("t")
    q = F.when(q.isNull(), F.raise_error(F.lit("a sample is absent at an edge of the surface")).cast("double")).otherwise(q)
    return v.withColumn(f"{name}_code", G.unorm16(q, low, high)).withColumn(name, (F.col(f"{name}_code") / 65535.0).cast("float")).drop("ex", "ey", "ez", "q0", "q1")


def interior_weights(iso: float) -> tuple[Column, list[Column]]:
    """The sum of the corners' weights 1 / (epsilon + |v - iso|), and the weighted mean place in the cube."""
    w = [1.0 / (F.lit(EPSILON) + F.abs(F.col(f"v{k}").cast("double") - F.lit(float(iso)))) for k in range(8)]
    total = sum(w[1:], w[0])
    return total, [sum((w[k] for k in range(8) if G.CORNERS[k][a]), F.lit(0.0)) / total for a in range(3)]


def joined_in_face(v: np.ndarray) -> np.ndarray:
    """For each cube and face: do the corners above the isovalue meet in the face? v: n x 8, less the isovalue.

    On an ambiguous face the bilinear interpolant's saddle decides; a saddle at zero counts as not joined."""
    out = np.zeros((len(v), 6), bool)
    for f, (a, b, c, d) in enumerate(FACES):
        det = v[:, a] * v[:, c] - v[:, b] * v[:, d]
        up = v > 0
        ambiguous = (up[:, a] == up[:, c]) & (up[:, b] == up[:, d]) & (up[:, a] != up[:, b])
        out[:, f] = ambiguous & np.where(up[:, a], det > EPSILON, det < -EPSILON)
    return out


def tunnels(v: np.ndarray) -> np.ndarray:
    """Whether two opposite corners of a slice across the cube, of one sign, meet inside the cube though not in its faces:
    along some axis, the slice's decider has an inner extremum at which both keep their sign and the other two have the other."""
    out = np.zeros(len(v), bool)
    for axis in range(3):
        low = [i for i in range(8) if CORNERS[i][axis] == 0]
        u, w = [a for a in range(3) if a != axis]
        ring = [next(i for i in low if CORNERS[i][u] == p and CORNERS[i][w] == q) for p, q in ((0, 0), (1, 0), (1, 1), (0, 1))]
        top = [next(i for i in range(8) if CORNERS[i][axis] == 1 and CORNERS[i][u] == CORNERS[r][u] and CORNERS[i][w] == CORNERS[r][w]) for r in ring]
        a0, b0, c0, d0 = (v[:, i] for i in ring)
        da, db, dc, dd = (v[:, j] - v[:, i] for i, j in zip(ring, top, strict=True))
        square = da * dc - db * dd
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -(a0 * dc + c0 * da - b0 * dd - d0 * db) / (2 * square)
        inside = np.isfinite(t) & (t > 0) & (t < 1)
        t = np.where(inside, t, 0.5)
        a, b, c, d = a0 + da * t, b0 + db * t, c0 + dc * t, d0 + dd * t
        for sign in (1, -1):
            out |= inside & (sign * a > 0) & (sign * c > 0) & (sign * b < 0) & (sign * d < 0) & (a * c - b * d > 0)
            out |= inside & (sign * b > 0) & (sign * d > 0) & (sign * a < 0) & (sign * c < 0) & (b * d - a * c > 0)
    return out


@cache
def pattern(code: int, faces: int, tunnel: bool) -> tuple[tuple[int, int, int], ...]:
    """Triangles over cut edges (INTERIOR_EDGE: the interior vertex) of a cube with these signs and decisions."""
    after: dict[int, list[int]] = {}
    for f, ring in enumerate(FACES):
        up = [code >> i & 1 for i in ring]
        cut = [k for k in range(4) if up[k] != up[(k + 1) % 4]]
        edge = [EDGE_OF[frozenset((ring[k], ring[(k + 1) % 4]))] for k in range(4)]
        # going round, the contour enters behind the last corner above and leaves before the first one
        ends = [k for k in cut if up[k]]
        for k in ends:
            starts = [m for m in cut if not up[m]]
            if len(cut) == 4:
                joined = faces >> f & 1
                to = (k + 1) % 4 if joined else (k - 1) % 4
            else:
                to = starts[0]
            after.setdefault(edge[k], []).append(edge[to])
    unclear = any(len([k for k in range(4) if (code >> ring[k] & 1) != (code >> ring[(k + 1) % 4] & 1)]) == 4 for ring in FACES)
    loops, left = [], {e: list(n) for e, n in after.items()}
    while left:
        start = min(left)
        loop, e = [start], left[start].pop()
        while e != start:
            loop.append(e)
            e = left[e].pop()
        left = {k: n for k, n in left.items() if n}
        loops.append(loop)
    # two corners that face each other across one face meet there or nowhere
    if len(loops) == 2 and tunnel and not (unclear and len(loops[0]) + len(loops[1]) == 6):
        return tuple(band(*loops))
    out = []
    for loop in loops:
        if len(loop) > 7:
            out += [(loop[i], loop[(i + 1) % len(loop)], 12) for i in range(len(loop))]
        else:
            out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return tuple(out)


MIDDLES = np.array([(CORNERS[a] + CORNERS[b]) / 2 for a, b, _ in EDGES])


def band(p: list[int], q: list[int]) -> list[tuple[int, int, int]]:
    """A band between two loops: the second is run backwards, from the vertices where both are nearest in all, and steps
    alternate in proportion to the loops' lengths, so no edge across comes twice."""
    far = lambda a, b: float(((MIDDLES[a] - MIDDLES[b]) ** 2).sum())
    n, m, q = len(p), len(q), q[::-1]

    def across(i: int, j: int) -> list[tuple[int, int, int]]:
        out, a, b = [], 0, 0
        at = lambda a, b: (p[(i + a) % n], q[(j + b) % m])
        while a < n or b < m:
            (x, y), first = at(a, b), (a + 1) * m <= (b + 1) * n
            if first:
                a += 1
                out.append((x, at(a, b)[0], y))
            else:
                b += 1
                out.append((x, at(a, b)[1], y))
        return out

    ways = [across(i, j) for i in range(n) for j in range(m)]
    return min(ways, key=lambda w: sum(far(x, z) for x, _, z in w))


def triangles(anchors: np.ndarray, v: np.ndarray, iso: float, origin, size) -> dict[str, np.ndarray]:
    """Of cubes (anchors n x 3, corner values n x 8): owner cube and three vertex keys (x, y, z, axis) of each face, turned so
    that its front faces the lower side; faces without area are left out. Also positions of interior vertices used."""
    v = v - iso
    code = ((v > 0) << np.arange(8)).sum(1)
    faces = (joined_in_face(v) << np.arange(6)).sum(1)
    key = np.stack([code, faces, tunnels(v)], axis=1)
    kinds, which = np.unique(key, axis=0, return_inverse=True)
    weight = 1.0 / (EPSILON + np.abs(v))
    centre = (weight @ CORNERS) / weight.sum(1, keepdims=True)
    rows, tri = [], []
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(kinds) + 1))
    for k, kind in enumerate(kinds.tolist()):
        shape = pattern(int(kind[0]), int(kind[1]), bool(kind[2]))
        if shape:
            own = order[cuts[k] : cuts[k + 1]]
            rows.append(np.repeat(own, len(shape)))
            tri.append(np.tile(np.array(shape), (len(own), 1)))
    if not rows:
        return {"cube": np.zeros(0, np.int64), "keys": np.zeros((0, 3, 4), np.int64)}
    cube, tri = np.concatenate(rows), np.concatenate(tri)
    low = np.array([e[0] for e in EDGES] + [0])
    high = np.array([e[1] for e in EDGES] + [0])
    axis = np.array([e[2] for e in EDGES] + [INTERIOR])
    inner = tri == 12
    s, e = v[cube[:, None], low[tri]], v[cube[:, None], high[tri]]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.clip(-s / (e - s), 0, 1)
    place = CORNERS[low[tri]] + t[..., None] * (CORNERS[high[tri]] - CORNERS[low[tri]])
    place = np.where(inner[..., None], centre[cube][:, None], place)
    point = (np.array(origin) + (anchors[cube][:, None] + place + 0.5) * np.array(size)).astype(np.float32)
    up = [CORNERS[:, a] == 1 for a in range(3)]
    grad = np.stack([(v[:, u].sum(1) - v[:, ~u].sum(1)) / (4 * d) for u, d in zip(up, size, strict=True)], axis=1).astype(np.float32)
    normal = np.cross(point[:, 1] - point[:, 0], point[:, 2] - point[:, 0])
    keys = np.concatenate([anchors[cube][:, None] + np.where(inner[..., None], 0, CORNERS[low[tri]]), axis[tri][..., None]], axis=2)
    turned = (normal * grad[cube]).sum(1) > 0
    keys[turned] = keys[turned][:, [0, 2, 1]]
    good = (normal**2).sum(1) > 0
    return {"cube": cube[good], "keys": keys[good]}


def faces(cubes: DataFrame, iso: float, origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0), flip: bool = False) -> DataFrame:
    """level, a, b, c: faces over packed vertex ids (see G.packed_id), from cubes with corner values; rows are independent."""

    def pack(level, k):
        return level << 56 | k[:, 2] << 38 | k[:, 1] << 20 | k[:, 0] << 2 | k[:, 3]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            got = triangles(np.stack([col[f"a{n}"] for n in XYZ], 1).astype(np.int64), np.stack([col[f"v{k}"].astype(np.float64) for k in range(8)], 1), iso, origin, size)
            level = col["level"].astype(np.int64)[got["cube"]]
            ids = [pack(level, got["keys"][:, i]) for i in ((0, 2, 1) if flip else (0, 1, 2))]
            yield pa.record_batch([pa.array(level.astype(np.int32)), *map(pa.array, ids)], ["level", "a", "b", "c"])

    return cubes.select("level", "ax", "ay", "az", *(f"v{k}" for k in range(8))).mapInArrow(run, "level int, a long, b long, c long")


def vertices(cubes: DataFrame, iso: float, faces_df: DataFrame, origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0)) -> DataFrame:
    """vid, level, px, py, pz: edge vertices of all cubes and the interior vertices that faces use."""
    edge = edge_vertices(None, iso, cubes, origin=origin, size=size)
    own = edge.select(G.packed_id(F.col("level"), *(F.col(n) for n in XYZ), F.col("axis")).alias("vid"), "level", "px", "py", "pz")
    used = faces_df.select(F.explode(F.array("a", "b", "c")).alias("vid")).where(F.col("vid").bitwiseAND(F.lit(3)) == INTERIOR).distinct()
    _, place = interior_weights(iso)
    inner = cubes.select(G.packed_id(F.col("level"), F.col("ax"), F.col("ay"), F.col("az"), F.lit(INTERIOR)).alias("vid"), "level", *((F.lit(float(o)) + (F.col(f"a{n}") + p + 0.5) * float(d)).cast("float").alias(f"p{n}") for p, n, o, d in zip(place, XYZ, origin, size, strict=True)))
    return own.unionByName(inner.join(used, "vid", "left_semi"))


def interior_samples(vertices_df: DataFrame, cubes: DataFrame, samples: DataFrame, iso: float, low: float, high: float, value: str = "v", name: str = "u") -> DataFrame:
    """The interior vertices (level, x, y, z: the cube's anchor) with `name`: the corners' samples by the weights that place the
    vertex, as a 16-bit code and back."""
    total, _ = interior_weights(iso)
    corners = F.array(*(F.struct(*(F.lit(int(c)).alias(f"d{n}") for c, n in zip(CORNERS[k], XYZ, strict=True)), (1.0 / (F.lit(EPSILON) + F.abs(F.col(f"v{k}").cast("double") - F.lit(float(iso))))).alias("w")) for k in range(8)))
    at = cubes.select("level", *(F.col(f"a{n}").alias(n) for n in XYZ), total.alias("total"), F.explode(corners).alias("c")).join(vertices_df.select("level", *XYZ), ["level", *XYZ], "left_semi")
    at = at.withColumns({f"e{n}": F.col(n) + F.col(f"c.d{n}") for n in XYZ})
    end = samples.select("level", *(F.col(n).alias(f"e{n}") for n in XYZ), F.col(value).cast("double").alias("q"))
    q = F.when(F.col("q").isNull(), F.raise_error(F.lit("a sample is absent at a cube of the surface")).cast("double")).otherwise(F.col("q"))
    mean = at.join(end, ["level", "ex", "ey", "ez"], "left").groupBy("level", *XYZ).agg((F.sum(F.col("c.w") * q) / F.first("total")).alias("__q"))
    out = vertices_df.join(mean, ["level", *XYZ]).withColumn(f"{name}_code", G.unorm16(F.col("__q"), low, high))
    return out.withColumn(name, (F.col(f"{name}_code") / 65535.0).cast("float")).drop("__q")


def isosurface(cells: DataFrame, iso: float, value: str = "v", origin=(0.0, 0.0, 0.0), size=(1.0, 1.0, 1.0), flip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, level, px, py, pz) and faces (level, a, b, c) of one level's surface on complete cubes."""
    levels = [r["level"] for r in cells.select("level").distinct().limit(2).collect()]
    if len(levels) > 1:
        raise ValueError("cells of one level are wanted; isosurface_of_levels() takes several")
    v, f = isosurface_of_levels({x: cells for x in levels or [0]}, iso, value, {x: (origin, size) for x in levels}, flip=flip)
    return v, f


def isosurface_of_levels(by_level: dict[int, DataFrame], iso: float, value: str = "v", geometry: dict[int, tuple] | None = None, steps: dict[int, tuple] | None = None,
                         level_range: tuple[int, int] | None = None, samples: list[tuple[str, float, float]] = (), flip: bool = False,
                         cubes: DataFrame | None = None, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, level, px, py, pz, and a 16-bit code and value for each sample) and faces (level, a, b, c) of the surface
    over all selected levels; a coarse cube whose anchor lies under the next finer selected level has none.

    by_level: cells (level, x, y, z, value, samples' columns). geometry: by level, (origin, cell size). steps: by coarse level,
    (ratio, shift) to the next finer one. level_range: first and last level, both included. samples: two at most, as (column,
    low, high), no column twice. cubes, ranges: all levels' complete cubes and chunk ranges, where they are known already."""
    validate(by_level, iso, level_range, samples)
    chosen = {k: c for k, c in sorted(by_level.items()) if level_range is None or level_range[0] <= k <= level_range[1]}
    named = {k: c.select("level", *XYZ, F.col(value).alias("v")) for k, c in chosen.items()}
    whole = {k: complete(c) if cubes is None else cubes.where(F.col("level") == k) for k, c in named.items()}
    active = checkpointed(active_cubes(whole, named, iso, steps, ranges))
    vs, fs = None, None
    for k, cells in chosen.items():
        origin, size = (geometry or {}).get(k, ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
        own = active.where(F.col("level") == k)
        f = faces(own, iso, origin, size, flip)
        v = sampled(vertices(own, iso, f, origin, size), own, cells, iso, samples) if samples else vertices(own, iso, f, origin, size)
        vs, fs = (v, f) if vs is None else (vs.unionByName(v), fs.unionByName(f))
    return vs, fs


def validate(by_level: dict[int, DataFrame], iso: float, level_range, samples) -> None:
    if not np.isfinite(iso):
        raise ValueError("the isovalue must be finite")
    if not by_level:
        raise ValueError("no level is given")
    if level_range is not None and not (min(by_level) <= level_range[0] <= level_range[1] <= max(by_level)):
        raise ValueError("the level range isn't one of the levels given")
    if len(samples) > 2 or len({s[0] for s in samples}) != len(samples):
        raise ValueError("at most two different samples")
    if any(not (np.isfinite(low) and np.isfinite(high) and low < high) for _, low, high in samples):
        raise ValueError("a sample's bounds must be finite and rising")


def sampled(vertices_df: DataFrame, cubes: DataFrame, cells: DataFrame, iso: float, samples) -> DataFrame:
    """vertices with each sample's code and value: along the edge, or over the corners' weights inside a cube."""
    field = lambda shift, bits: F.shiftright("vid", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    keyed = vertices_df.withColumns({"x": field(2, 18), "y": field(20, 18), "z": field(38, 18), "axis": field(0, 2)})
    start = [F.col(f"v{a}").cast("double") for a in range(8)]
    parts = F.array(*(F.struct(*(F.lit(int(c)).alias(f"d{n}") for c, n in zip(CORNERS[a], XYZ, strict=True)), F.lit(axis).alias("axis"), start[a].alias("s"), start[b].alias("e")) for a, b, axis in EDGES))
    cut = cubes.select("level", "ax", "ay", "az", F.explode(parts).alias("e")).where((F.col("e.s") > iso) != (F.col("e.e") > iso))
    cut = cut.select("level", *((F.col(f"a{n}") + F.col(f"e.d{n}")).alias(n) for n in XYZ), F.col("e.axis").alias("axis"), along("e.s", "e.e", iso).alias("t")).distinct()
    edge, inner = keyed.join(cut, ["level", *XYZ, "axis"]), keyed.where(F.col("axis") == INTERIOR)
    for column, low, high in samples:
        edge = edge_samples(edge, cells, low, high, column, f"u_{column}")
        inner = interior_samples(inner, cubes, cells, iso, low, high, column, f"u_{column}")
    return edge.drop("t", *XYZ, "axis").unionByName(inner.drop(*XYZ, "axis"))


def along(s: str, e: str, iso: float) -> Column:
    """Where on the way from s to e the surface lies, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(iso)) - F.col(s)) / (F.col(e) - F.col(s))))
