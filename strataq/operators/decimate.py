"""Mesh decimation by quadric edge collapse: small meshes in one task, large ones by spatial groups with fixed borders."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.lineage import checkpointed
from strataq.operators import mesh as M


@dataclass(frozen=True)
class Options:
    """faces: a count, or a fraction in (0, 1]; max_error: relative to the mesh's extent or in its units. From grouped_from
    faces on, groups of about group_faces are simplified first; reserve is the part of the removal left to the last pass."""

    faces: float = 0.5
    max_error: float = 0.01
    relative: bool = True
    uv_weights: tuple[float, float] = (1.0, 1.0)
    lock_boundaries: bool = True
    grouped_from: int = 100_000
    group_faces: int = 8192
    reserve: float = 0.15
    group_error: float = 0.5

    def __post_init__(self):
        if not (self.faces > 0 and self.max_error >= 0 and np.isfinite(self.max_error) and 0 <= self.reserve <= 1 and 0 <= self.group_error <= 1):
            raise ValueError("options out of range")

    def target(self, n: int) -> int:
        return max(1, int(np.floor(n * self.faces))) if self.faces <= 1 else int(self.faces)


def collapse(p: np.ndarray, uv: np.ndarray, tri: np.ndarray, target: int, limit: float, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Which faces are left, and their corners, after collapsing edges, cheapest first, onto one of their ends until the target or
    the error limit is reached.

    A vertex that is fixed stays. A collapse that would turn a face over, or join vertices with more than two common
    neighbours, is left out, so the surface stays a manifold where it was one."""
    n = len(p)
    faces = [tuple(t) for t in tri.tolist()]
    alive = [True] * len(faces)
    of: list[set[int]] = [set() for _ in range(n)]
    for i, t in enumerate(faces):
        for v in t:
            of[v].add(i)
    normal = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    unit = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
    planes = np.c_[unit, -(unit * p[tri[:, 0]]).sum(1)]
    upper = [(i, j) for i in range(4) for j in range(i, 4)]
    terms = np.stack([planes[:, i] * planes[:, j] * (1 if i == j else 2) for i, j in upper], axis=1)
    sums = np.zeros((n, 10))
    for k in range(3):
        np.add.at(sums, tri[:, k], terms)
    age = [0] * n
    pairs = np.unique(np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1), axis=0)
    pairs = np.concatenate([pairs, pairs[:, ::-1]])
    pairs = pairs[~fixed[pairs[:, 0]]]
    h = np.c_[p, np.ones(n)]
    onto = np.stack([h[:, i] * h[:, j] for i, j in upper], axis=1)[pairs[:, 1]]
    first = np.maximum(0.0, ((sums[pairs[:, 0]] + sums[pairs[:, 1]]) * onto).sum(1)) + ((uv[pairs[:, 0]] - uv[pairs[:, 1]]) ** 2).sum(1)
    heap = [(c, u, v, 0, 0) for c, (u, v) in zip(first.tolist(), pairs.tolist(), strict=True)]
    heapq.heapify(heap)
    place, at, quadric, front, held = p.tolist(), uv.tolist(), sums.tolist(), unit.tolist(), fixed.tolist()

    def push(u: int, v: int) -> None:  # the cost of moving one end onto the other
        q = [s + t for s, t in zip(quadric[u], quadric[v], strict=True)]
        apart = (at[u][0] - at[v][0]) ** 2 + (at[u][1] - at[v][1]) ** 2
        for a, b in ((u, v), (v, u)):
            if not held[a]:
                x, y, z = place[b]
                c = q[0] * x * x + q[1] * x * y + q[2] * x * z + q[3] * x + q[4] * y * y + q[5] * y * z + q[6] * y + q[7] * z * z + q[8] * z + q[9]
                heapq.heappush(heap, (max(0.0, c) + apart, a, b, age[a], age[b]))

    left, worst = len(faces), 0.0
    while heap and left > target:
        c, u, v, au, av = heapq.heappop(heap)
        if c > limit * limit:
            break
        if age[u] != au or age[v] != av:
            continue
        ring = lambda x: {w for i in of[x] for w in faces[i]} - {x}
        shared = of[u] & of[v]
        if not shared:
            continue
        ring_u, ring_v = ring(u), ring(v)
        if len(ring_u & ring_v) != len(shared):
            continue
        moved = [i for i in of[u] if i not in shared]
        turns = False
        for i in moved:
            (ax, ay, az), (bx, by, bz), (dx, dy, dz) = (place[v] if w == u else place[w] for w in faces[i])
            bx, by, bz, dx, dy, dz = bx - ax, by - ay, bz - az, dx - ax, dy - ay, dz - az
            x, y, z = front[i]
            if (by * dz - bz * dy) * x + (bz * dx - bx * dz) * y + (bx * dy - by * dx) * z <= 0:
                turns = True
                break
        if turns:
            continue
        around = ring_u | ring_v
        for i in shared:
            alive[i] = False
            for w in faces[i]:
                of[w].discard(i)
        for i in moved:
            faces[i] = tuple(v if w == u else w for w in faces[i])
            of[v].add(i)
        of[u] = set()
        quadric[v] = [s + t for s, t in zip(quadric[u], quadric[v], strict=True)]
        age[u], age[v] = age[u] + 1, age[v] + 1
        left -= len(shared)
        worst = max(worst, c)
        for w in around - {u, v}:
            if of[w]:
                push(v, w)
    kept = np.flatnonzero(alive)
    return kept, np.array([faces[i] for i in kept], np.int64).reshape(-1, 3), float(np.sqrt(worst))


def simplify(pdf: pd.DataFrame, target: int, limit: float, lock: bool, weights: tuple[float, float]) -> tuple[pd.DataFrame, float]:
    """pdf: faces (fid, a, b, c) with corner positions (a_px, ..., c_pz, and a_u, a_v, ... if there), of which those left are given
    in the same form; locked: edges of one face. Faces are taken by their fid and vertices by their first appearance, so the
    order of the rows doesn't matter."""
    pdf = pdf.sort_values("fid", ignore_index=True)
    ids, first, tri = np.unique(pdf[["a", "b", "c"]].to_numpy().ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, tri = ids[order], rank[tri].reshape(-1, 3)
    p, uv = np.zeros((len(ids), 3)), np.zeros((len(ids), 2))
    for k, n in enumerate("abc"):
        p[tri[:, k]] = pdf[[f"{n}_{x}" for x in M.P]].to_numpy(np.float64)
        if f"{n}_u" in pdf:
            uv[tri[:, k]] = pdf[[f"{n}_u", f"{n}_v"]].to_numpy(np.float64)
    edge = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    pair, count = np.unique(edge, axis=0, return_counts=True)
    fixed = np.zeros(len(ids), bool)
    fixed[pair[(count > 2) | ((count == 1) & lock)].ravel()] = True
    kept, out, error = collapse(p, uv * np.sqrt(weights) * limit, tri, target, limit, fixed)
    left = pdf.iloc[kept].copy()
    for k, n in enumerate("abc"):
        left[n] = ids[out[:, k]]
        for i, x in enumerate(M.P):
            left[f"{n}_{x}"] = p[out[:, k], i]
        if f"{n}_u" in left:
            left[f"{n}_u"], left[f"{n}_v"] = uv[out[:, k]].T
    return left, error


#: Most cells whose faces are counted for one pass; the counts come to the driver.
MOST_CELLS = 1 << 19


def grouped(cornered: DataFrame, box: dict, n: int, group_faces: int, turn: int) -> DataFrame:
    """cornered with `group`: runs of about group_faces faces along the Morton curve of cubical cells, of which there are about 32
    for each group at most. Every other turn, cells and runs are moved by half their size."""
    low, span = np.array([box[f"min_{p}"] for p in M.P], float), np.array([box[f"max_{p}"] - box[f"min_{p}"] for p in M.P], float)
    most = min(MOST_CELLS, 32 * max(1, n // group_faces))
    size = max(float(span.max()), 1e-30)
    while np.prod(np.floor(2 * span / size) + 2) <= most and size > 1e-6 * span.max():
        size /= 2
    half = 0.5 * (turn % 2)
    cell = [F.floor(((F.col(f"a_{p}").cast("double") + F.col(f"b_{p}") + F.col(f"c_{p}")) / 3 - float(lo)) / size + half).cast("int").alias(f"g_{p}") for p, lo in zip(M.P, low, strict=True)]
    placed = cornered.select("*", *cell)
    keys = [f"g_{p}" for p in M.P]
    cells = placed.groupBy(*keys).agg(F.count("*").alias("n")).toPandas()
    code = np.zeros(len(cells), np.int64)
    for axis, k in enumerate(keys):
        g = cells[k].to_numpy(np.int64)
        for bit in range(20):
            code |= (g >> bit & 1) << (3 * bit + axis)
    cells = cells.iloc[np.argsort(code)]
    middle = cells["n"].cumsum() - cells["n"] / 2
    cells["group"] = (middle / group_faces + half).astype("int64")
    runs = cornered.sparkSession.createDataFrame(cells[[*keys, "group"]], ", ".join(f"{k} int" for k in keys) + ", group long")
    return placed.join(F.broadcast(runs), keys).drop(*keys)


def cornered(vertices: DataFrame, faces: DataFrame, options: Options) -> DataFrame:
    """Written once: fid, a, b, c, the corners' positions (and u, v if they count), lost: whether a corner isn't there."""
    extra = ("u", "v") if {"u", "v"} <= set(vertices.columns) and any(options.uv_weights) else ()
    out = faces.select("fid", "a", "b", "c")
    for n in "abc":
        own = vertices.select(F.col("vid").alias(n), F.lit(True).alias(f"{n}_there"), *(F.col(p).alias(f"{n}_{p}") for p in (*M.P, *extra)))
        out = out.join(own, n, "left")
    there = F.col("a_there") & F.col("b_there") & F.col("c_there")
    return checkpointed(out.select("fid", "a", "b", "c", *(f"{n}_{p}" for n in "abc" for p in (*M.P, *extra)), there.isNull().alias("lost")))


def decimate(vertices: DataFrame, faces: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, dict]:
    """Vertices (only those still named) and faces, and a report: faces before and after, error, whether the target was reached.

    Faces are joined with their corners once and carry them from then on. A large mesh is cut into groups of faces that lie
    together; each group keeps its border fixed, so groups are independent. Such passes are repeated, the groups moved each
    time, while more than `grouped_from` faces are left, until a pass takes off under 2 % and under half of what is too much;
    the last pass runs as one task, over fewer faces than that."""
    whole = cornered(vertices, faces, options)
    wrong = {r["rule"] for r in M.validate(vertices, faces.limit(0)).collect()} | (set() if whole.where("lost").isEmpty() else {"face index"})
    if wrong:
        raise ValueError(f"not a mesh: {', '.join(sorted(wrong))}")
    return _decimate(vertices, whole.drop("lost"), options)


def _decimate(vertices: DataFrame, faces: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, dict]:
    """See decimate(); faces: those of cornered()."""
    corner = F.explode(F.array(*(F.struct(*(F.col(f"{n}_{p}").alias(p) for p in M.P)) for n in "abc")))
    ends = [f(f"p.{p}").alias(f"{f.__name__}_{p}") for p in M.P for f in (F.min, F.max)]
    box = faces.select(corner.alias("p")).agg(F.count("*").alias("n"), *ends).first().asDict()
    n = box["n"] // 3
    target = options.target(n)
    report = {"original": n, "final": n, "error": 0.0, "reached": n <= target, "groups": 0}
    if not n or n <= target:
        return *M.compact_vertices(vertices, faces.select("fid", "a", "b", "c")), report
    size = max(box[f"max_{p}"] - box[f"min_{p}"] for p in M.P)
    limit = options.max_error * size if options.relative else options.max_error
    names = faces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faces.schema) + ", error double"

    def run(goal, most, lock):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            out, error = simplify(pdf[names], int(goal(len(pdf))), most, lock, options.uv_weights)
            return out.assign(error=error)

        return one

    spent, left, goal = 0.0, n, min(n, target + int(np.ceil((n - target) * options.reserve)))
    while left >= options.grouped_from and left > target:
        placed = grouped(faces, box, left, options.group_faces, report["groups"])
        parts = checkpointed(placed.groupBy("group").applyInPandas(run(lambda k, share=goal / left: max(1, k * share), (limit - spent) * options.group_error, True), schema))
        before = left
        left, error = parts.agg(F.count("*"), F.max("error")).first()
        goal = target if report["groups"] == 0 else max(1, 2 * target - left)  # others make up for groups that can't give more
        spent += error or 0.0
        faces = parts.select(*names)
        report["groups"] += 1
        if left > 0.98 * before and left - target > 0.5 * (before - target):
            break
    out = faces.select("fid", "a", "b", "c", F.lit(spent).alias("error"))
    if target < left < options.grouped_from:
        out = checkpointed(faces.groupBy(F.lit(0).alias("all")).applyInPandas(run(lambda k: target, limit - spent, options.lock_boundaries), schema).select("fid", "a", "b", "c", "error"))
    report["final"], error = out.agg(F.count("*"), F.max("error")).first()
    report["error"] = max(spent, error or 0.0)
    report["reached"] = report["final"] <= target
    numbered = checkpointed(M.dense_numbers(out.select("fid", "a", "b", "c"), "fid", "new").select(F.col("new").alias("fid"), "a", "b", "c"))
    return *M.compact_vertices(vertices, numbered), report


def pipeline(vertices: DataFrame, faces: DataFrame, epsilon: float = 0.0, options: Options = Options()) -> tuple[DataFrame, DataFrame, dict]:
    """Degenerate faces out and unused vertices, then decimated."""
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    n = faces.count()
    whole = cornered(vertices, faces.where(~M.degenerate()), options)
    if not whole.where("lost").isEmpty():
        raise ValueError("a face names a vertex that isn't there")
    kept = whole.where(M.area_squared() > epsilon * epsilon).drop("lost")
    corner = kept.select(F.explode(F.array("a", "b", "c")).alias("vid"), F.lit(0).alias("own"), F.lit(False).alias("bad"))
    bad = ~(F.abs(F.col("px") + F.col("py") + F.col("pz")) < float("inf"))
    seen = corner.unionByName(vertices.select("vid", F.lit(1).alias("own"), bad.alias("bad"))).groupBy("vid").agg(F.sum("own").alias("n"), (F.min("own") == 0).alias("used"), F.max("bad").alias("bad"))
    found = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("twice", F.when(F.col("used") & (F.col("n") > 1), 1)), ("bad", F.when(F.col("used") & F.col("bad"), 1)), ("unused", F.when(~F.col("used"), F.col("n")))))).first()
    wrong = [rule for rule, name in (("position", "bad"), ("vertex id", "twice")) if found[name]]
    if wrong:
        raise ValueError(f"not a mesh: {', '.join(wrong)}")
    v, f, report = _decimate(vertices, kept, options)
    return v, f, report | {"degenerate": n - report["original"], "unused": found["unused"]}
