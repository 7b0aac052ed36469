"""Triangle meshes as two tables: vertices (vid, px, py, pz, ...) and faces (fid, a, b, c)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.lineage import checkpointed

P = ["px", "py", "pz"]


def corners(faces: DataFrame, vertices: DataFrame, *extra: str) -> DataFrame:
    """faces with their corners' positions a_px, ..., c_pz; a face whose vertex is missing is an error."""
    out = faces
    for n in "abc":
        own = vertices.select(F.col("vid").alias(n), F.lit(True).alias(f"{n}_there"), *(F.col(p).alias(f"{n}_{p}") for p in (*P, *extra)))
        out = out.join(own, n, "left")
    there = F.col("a_there") & F.col("b_there") & F.col("c_there")
    check = F.when(there.isNull(), F.raise_error(F.lit("a face names a vertex that isn't there")).cast("boolean")).otherwise(F.lit(True))
    return out.where(check).drop("a_there", "b_there", "c_there")


def area_squared() -> Column:
    """Squared triangle area from corner positions."""
    d = [[F.col(f"{n}_{p}").cast("double") - F.col(f"a_{p}").cast("double") for p in P] for n in "bc"]
    (ux, uy, uz), (vx, vy, vz) = d
    x, y, z = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    return (x * x + y * y + z * z) * 0.25


def degenerate() -> Column:
    return (F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))


def remove_degenerate(faces: DataFrame, vertices: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Faces with three different vertices and an area above epsilon."""
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    names = faces.columns
    return corners(faces.where(~degenerate()), vertices).where(area_squared() > epsilon * epsilon).select(*names)


def edges(faces: DataFrame) -> DataFrame:
    """u < v, n: undirected edges and how many faces have them."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(F.explode(pairs).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("n"))


def locked(edge_counts: DataFrame, boundaries: bool = True) -> DataFrame:
    """vid of vertices on edges with more than two faces and, if boundaries count, on those with one."""
    bad = (F.col("n") > 2) | (F.col("n") == 1) if boundaries else F.col("n") > 2
    return edge_counts.where(bad).select(F.explode(F.array("u", "v")).alias("vid")).distinct()


def adjacency(edge_counts: DataFrame) -> DataFrame:
    """src, dst both ways."""
    return edge_counts.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")


def degrees(edge_counts: DataFrame) -> DataFrame:
    return adjacency(edge_counts).groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))


def distance(p: str, q: str) -> Column:
    d = [F.col(f"{p}_{c}").cast("double") - F.col(f"{q}_{c}").cast("double") for c in P]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def at(vertices: DataFrame, key: str, prefix: str) -> DataFrame:
    return vertices.select(F.col("vid").alias(key), *(F.col(p).alias(f"{prefix}_{p}") for p in P))


def mean_edge_lengths(edge_counts: DataFrame, vertices: DataFrame) -> DataFrame:
    e = edge_counts.join(at(vertices, "u", "s"), "u").join(at(vertices, "v", "d"), "v").withColumn("length", distance("s", "d"))
    both = e.select(F.explode(F.array("u", "v")).alias("vid"), "length")
    return both.groupBy("vid").agg(F.avg("length").alias("mean_length"))


def relax_pass(vertices: DataFrame, adjacent: DataFrame, fixed: DataFrame, means: DataFrame, factor: float, step: float) -> DataFrame:
    """One smoothing pass: each free vertex moves by factor toward the centroid of its neighbours as they were, by step times
    its first mean edge length at most. Locked and isolated vertices stay; positions are floats."""
    near = adjacent.join(at(vertices, "dst", "n"), "dst").groupBy("src").agg(*(F.avg(F.col(f"n_{p}").cast("double")).alias(f"m_{p}") for p in P)).withColumnRenamed("src", "vid")
    free = near.join(fixed, "vid", "left_anti").join(means, "vid")
    v = vertices.join(free, "vid", "left")
    d = {p: (F.col(f"m_{p}") - F.col(p).cast("double")) * factor for p in P}
    length = F.sqrt(sum((x * x for x in list(d.values())[1:]), d["px"] * d["px"]))
    most = F.col("mean_length") * step
    scale = F.when(length > most, most / length).otherwise(1.0)
    return v.select(*(c if c not in P else F.coalesce((F.col(c).cast("double") + d[c] * scale).cast("float"), F.col(c)).alias(c) for c in vertices.columns))


#: Vertices of a block that one task relaxes at a time.
BLOCK = 1 << 15


def relax(vertices: DataFrame, faces: DataFrame, iterations: int = 3, shrink: float = 0.5, swell: float = -0.53, step: float = 0.25, lock_boundaries: bool = True) -> DataFrame:
    """Taubin smoothing: pairs of a shrinking and a swelling pass, each as relax_pass() says.

    Blocks are ranges of about BLOCK vertex ids. A block's neighbour lists are worked out once from all faces that touch it; a pass
    brings it its own vertices' places and those of neighbours in other blocks, which are few where near vertices have near
    ids. Lineage is cut after each pass."""
    if iterations < 0 or not 0 <= shrink <= 1 or not -1 <= swell <= 0 or not 0 <= step < float("inf"):
        raise ValueError("options out of range")
    faces = checkpointed(faces.select("a", "b", "c"))
    if not faces.where(degenerate()).isEmpty():
        raise ValueError("a face repeats a vertex")
    names, kinds = vertices.columns, {p: vertices.schema[p].dataType for p in P}
    places = checkpointed(vertices.select("vid", *P))
    n = places.count()
    parts = max(1, n // BLOCK)
    cuts = places.approxQuantile("vid", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    first = np.unique(np.array(cuts, np.int64))  # the first ids of all blocks but one
    stars = checkpointed(dealt(faces, first).groupBy("block").applyInArrow(neighbours(first, lock_boundaries), "block int, vid long, free boolean, near array<long>, far array<long>"))
    if not stars.join(places, "vid", "left_anti").isEmpty():
        raise ValueError("a face names a vertex that isn't there")
    halo = checkpointed(stars.select("block", F.explode("far").alias("vid")).distinct())
    free = stars.where("free").select("block", "vid", "near")
    schema = "block int, vid long, " + ", ".join(f"{p} {kinds[p].simpleString()}" for p in P) + ", mean double"
    at = located(places, first, schema)
    for i in range(2 * iterations):
        others = at.drop("block").join(halo, "vid").select("block", "vid", *P, "mean", F.lit(False).alias("own"))
        here = at.select("block", "vid", *P, "mean", F.lit(True).alias("own")).unionByName(others)
        at = checkpointed(free.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(moved(swell if i % 2 else shrink, step, i == 0), schema))
    if set(names) == {"vid", *P}:
        return at.select(*names)
    return vertices.drop(*P).join(at.select("vid", *P), "vid").select(*names)


def dealt(faces: DataFrame, first: np.ndarray) -> DataFrame:
    """block, a, b, c: each face for every block that one of its vertices lies in."""

    def run(batches):
        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            block = np.searchsorted(first, t, "right").astype(np.int32)
            for k, own in enumerate((np.ones(len(t), bool), block[:, 1] != block[:, 0], (block[:, 2] != block[:, 0]) & (block[:, 2] != block[:, 1]))):
                if own.any():
                    yield pa.record_batch([pa.array(block[own, k]), *(pa.array(t[own, i]) for i in range(3))], ["block", "a", "b", "c"])

    return faces.select("a", "b", "c").mapInArrow(run, "block int, a long, b long, c long")


def located(places: DataFrame, first: np.ndarray, schema: str) -> DataFrame:
    """places with their block, and a mean edge length that isn't known yet."""

    def run(batches):
        for batch in batches:
            block = np.searchsorted(first, batch.column(0).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.record_batch([pa.array(block), *batch.columns, pa.array(np.full(len(block), np.nan))], ["block", "vid", *P, "mean"])

    return places.mapInArrow(run, schema)


def neighbours(first: np.ndarray, lock_boundaries: bool):
    """Of all faces that touch a block: its vertices, whether they are free, their neighbours and those of them in other blocks."""

    def run(faces: pa.Table) -> pa.Table:
        block = faces.column("block")[0].as_py()
        ids, tri = np.unique(np.concatenate([faces.column(c).to_numpy() for c in "abc"]), return_inverse=True)
        tri = tri.reshape(3, -1)
        ways = np.concatenate([tri[i] * len(ids) + tri[j] for i in range(3) for j in range(3) if i != j])
        ways, count = np.unique(ways, return_counts=True)
        src, dst = ways // len(ids), ways % len(ids)
        free = np.ones(len(ids), bool)
        free[src[(count > 2) | ((count == 1) & lock_boundaries)]] = False
        home = np.searchsorted(first, ids, "right") == block
        own = np.flatnonzero(home)

        def lists(some: np.ndarray) -> pa.Array:
            size = np.bincount(src[some], minlength=len(ids))[own]
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(ids[dst[some]]))

        useful = home[src] & free[src]
        return pa.table({"block": pa.array(np.full(len(own), block, np.int32)), "vid": ids[own], "free": free[own], "near": lists(useful), "far": lists(useful & ~home[dst])})

    return run


def moved(factor: float, step: float, opening: bool):
    """One pass over a block: places of its vertices after it. The opening pass works out the mean edge lengths."""

    def run(stars: pa.Table, here: pa.Table) -> pa.Table:
        order = np.argsort(here.column("vid").to_numpy(), kind="stable")
        vid, own = here.column("vid").to_numpy()[order], here.column("own").to_numpy()[order]
        p = np.stack([here.column(x).to_numpy()[order].astype(np.float64) for x in P], axis=1)
        mean = here.column("mean").to_numpy()[order].copy()
        if stars.num_rows:
            lists = pa.concat_arrays(stars.column("near").chunks)
            size = lists.value_lengths().to_numpy()
            near, me = np.searchsorted(vid, lists.flatten().to_numpy()), np.searchsorted(vid, stars.column("vid").to_numpy())
            begin = np.r_[0, np.cumsum(size)[:-1]]
            if opening:
                mean[me] = np.add.reduceat(np.sqrt(((p[near] - p[np.repeat(me, size)]) ** 2).sum(1)), begin) / size
            d = (np.add.reduceat(p[near], begin, axis=0) / size[:, None] - p[me]) * factor
            length, most = np.sqrt((d**2).sum(1)), mean[me] * step
            scale = np.where(length > most, most / np.where(length > 0, length, 1.0), 1.0)
            p[me] = (p[me] + d * scale[:, None]).astype(np.float32)
        kept = {"block": here.column("block").to_numpy()[order][own], "vid": vid[own], **{x: p[own, i] for i, x in enumerate(P)}, "mean": mean[own]}
        return pa.table({n: pa.array(v).cast(here.schema.field(n).type) for n, v in kept.items()})

    return run


def compact_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the vertices that faces name, numbered from 0 by their first appearance in face order.

    Numbers come from counts by range of first places plus a rank inside each range, so no single task ranks all vertices."""
    first = faces.select(F.posexplode(F.array("a", "b", "c")).alias("pos", "vid"), "fid").groupBy("vid").agg(F.min(F.col("fid") * 3 + F.col("pos")).alias("first"))
    new = dense_numbers(first, "first", "new")
    kept = vertices.join(new.select("vid", "new"), "vid")
    kept = kept.select(F.col("new").alias("vid"), *(c for c in vertices.columns if c != "vid"))
    out = faces
    for n in "abc":
        out = out.join(new.select(F.col("vid").alias(n), F.col("new").alias(f"new_{n}")), n).drop(n).withColumnRenamed(f"new_{n}", n)
    return kept, out.select(*faces.columns)


def dense_numbers(df: DataFrame, order: str, name: str, width: int = 1 << 20) -> DataFrame:
    """df with the rank from 0 of its distinct long `order`, worked out by blocks of `width` values."""
    block = F.floor(F.col(order) / width).cast("long")
    tagged = df.withColumn("__block", block)
    sizes = tagged.groupBy("__block").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    out = tagged.join(before.select("__block", F.coalesce("__before", F.lit(0)).alias("__before")), "__block").withColumn(name, (F.col("__before") + rank).cast("long"))
    return out.drop("__block", "__before")


def weld(vertices: DataFrame, key: list[str]) -> DataFrame:
    """One vertex for each key (the least vid); copies that differ in position are an error."""
    same = F.min(F.struct(*P)) == F.max(F.struct(*P))
    checked = F.when(same, F.min("vid")).otherwise(F.raise_error(F.lit("vertices of one key differ")).cast("long"))
    return vertices.groupBy(*key).agg(checked.alias("vid"), *(F.min(p).alias(p) for p in P))


def distinct_faces(faces: DataFrame) -> DataFrame:
    """One face (the least fid) for each set of vertices."""
    k = F.array_sort(F.array("a", "b", "c"))
    one = faces.groupBy(k.alias("k")).agg(F.min(F.struct("fid", "a", "b", "c")).alias("f"))
    return one.select("f.*")


def concat(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One mesh of several, ids moved past those before."""
    vs, fs, v0, f0 = None, None, 0, 0
    for v, f in meshes:
        w = v.withColumn("vid", F.col("vid") + v0)
        g = f.select((F.col("fid") + f0).alias("fid"), *((F.col(n) + v0).alias(n) for n in "abc"))
        vs, fs = (w, g) if vs is None else (vs.unionByName(w), fs.unionByName(g))
        if len(meshes) > 1:
            v0, f0 = v0 + following(v, "vid"), f0 + following(f, "fid")
    return vs, fs


def following(df: DataFrame, number: str) -> int:
    """The first number from 0 on that is beyond all of df's."""
    most = df.agg(F.max(number)).first()[0]
    return 0 if most is None else most + 1


def flip(faces: DataFrame) -> DataFrame:
    return faces.select(*(F.col({"b": "c", "c": "b"}.get(n, n)).alias(n) for n in faces.columns))


def validate(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """rule, n: positions that aren't finite, repeated vertex ids, faces with unknown vertices; rules that hold are absent."""
    bad = vertices.where(~(F.abs(F.col("px") + F.col("py") + F.col("pz")) < float("inf"))).select(F.lit("position").alias("rule"))
    twice = vertices.groupBy("vid").count().where("count > 1").select(F.lit("vertex id").alias("rule"))
    lost = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).join(vertices, "vid", "left_anti").select(F.lit("face index").alias("rule"))
    return bad.union(twice).union(lost).groupBy("rule").agg(F.count("*").alias("n"))
