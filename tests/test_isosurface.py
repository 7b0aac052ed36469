from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.operators import isosurface as I
from tests.test_cells import full, grid


def test_plane_in_one_cube(spark):
    v, f = I.isosurface(grid(spark, full(2, 2, 2, lambda x, y, z: float(x))), 0.5)
    v, f = v.toPandas(), f.toPandas()
    assert len(v) == 4 and set(v.px) == {1.0} and len(f) == 2
    p = v.set_index("vid")[["px", "py", "pz"]]
    for r in f.itertuples():
        a, b, c = (p.loc[i].to_numpy() for i in (r.a, r.b, r.c))
        assert np.cross(b - a, c - a)[0] < 0


def test_plane_across_chunks(spark):
    v, f = I.isosurface(grid(spark, full(2, 34, 2, lambda x, y, z: float(x))), 0.5)
    assert (v.count(), f.count()) == (68, 66)
    assert v.select("vid").distinct().count() == 68


def test_every_pattern_uses_its_cut_edges_and_closes():
    rng = np.random.default_rng(0)
    anchors = np.zeros((1, 3), np.int64)
    for code in range(256):
        for _ in range(20):
            v = np.where(np.array([code >> k & 1 for k in range(8)]) == 1, 1, -1) * rng.uniform(0.1, 1, 8)
            got = I.triangles(anchors, v[None], 0.0, (0, 0, 0), (1, 1, 1))
            used = {tuple(k) for k in got["keys"].reshape(-1, 4).tolist() if k[3] != I.INTERIOR}
            cut = {(*map(int, I.CORNERS[a]), x) for a, b, x in I.EDGES if (v[a] > 0) != (v[b] > 0)}
            assert used == cut
            # inside the cube each edge of the surface has two faces; the rest lie on the cube's faces, each once
            count = Counter(frozenset(map(tuple, e)) for t in got["keys"].tolist() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
            assert max(count.values(), default=1) <= 2
            on_boundary = [e for e, n in count.items() if n == 1]
            degree = Counter(p for e in on_boundary for p in e)
            assert all(n == 2 for n in degree.values()) and set(degree) == cut


def test_random_field_is_closed_inside(spark):
    rng = np.random.default_rng(7)
    n = 7
    values = rng.normal(size=(n, n, n))
    values[[0, -1]] = values[:, [0, -1]] = values[:, :, [0, -1]] = -1.0
    v, f = I.isosurface(grid(spark, full(n, n, n, lambda x, y, z: values[x, y, z])), 0.0)
    f, ids = f.toPandas(), set(v.toPandas().vid)
    assert set(f[["a", "b", "c"]].to_numpy().ravel()) == ids
    count = Counter(frozenset(e) for a, b, c in f[["a", "b", "c"]].itertuples(index=False) for e in ((a, b), (b, c), (c, a)))
    assert set(count.values()) <= {2, 4} and Counter(count.values())[2] > 0.99 * len(count)


def test_attributes_on_edges(spark):
    cells = grid(spark, full(2, 1, 1, lambda x, y, z: float(x)))
    v = I.edge_vertices(cells, 0.25)
    u = I.edge_samples(v, cells.withColumn("q", F.col("x") * 10.0), 0.0, 10.0, "q")
    w = I.edge_samples(v, cells.withColumn("q", F.col("x") * 20.0 - 5.0), 0.0, 10.0, "q")
    assert (u.first()["u_code"], w.first()["u_code"]) == (16384, 0)
    with pytest.raises(Exception, match="absent"):
        I.edge_samples(v, cells.where("x = 0").withColumn("q", F.lit(1.0)), 0.0, 1.0, "q").collect()


def test_winding_flips(spark):
    c = grid(spark, full(2, 2, 2, lambda x, y, z: float(x)))
    _, f = I.isosurface(c, 0.5)
    _, g = I.isosurface(c, 0.5, flip=True)
    assert sorted((r.a, r.c, r.b) for r in f.collect()) == sorted((r.a, r.b, r.c) for r in g.collect())


def test_empty_and_nan(spark):
    _, f = I.isosurface(grid(spark, full(2, 2, 2)).where("false"), 0.5)
    assert f.isEmpty()
    with pytest.raises(ValueError):
        I.isosurface(grid(spark, full(2, 2, 2)), float("nan"))


def test_a_covered_coarse_level_shows_nothing(spark):
    coarse = grid(spark, full(4, 4, 4, lambda x, y, z: float(x)), level=0)
    fine = grid(spark, full(8, 8, 8, lambda x, y, z: x / 2), level=1)
    sizes = {0: ((0.0,) * 3, (2.0,) * 3), 1: ((0.0,) * 3, (1.0,) * 3)}
    v, f = I.isosurface_of_levels({0: coarse, 1: fine}, 1.2, geometry=sizes)
    assert {r["level"] for r in f.collect()} == {1} and {r["level"] for r in v.collect()} == {1}
    _, alone = I.isosurface_of_levels({0: coarse, 1: fine}, 1.2, geometry=sizes, level_range=(0, 0))
    assert {r["level"] for r in alone.collect()} == {0}
    half = fine.where("x < 4")
    _, both = I.isosurface_of_levels({0: coarse, 1: half}, 1.2, geometry=sizes)
    assert {r["level"] for r in both.collect()} == {1} and both.count() == f.count()
    _, moved = I.isosurface_of_levels({0: coarse, 1: half}, 1.2, geometry=sizes, steps={0: ((2, 2, 2), (-8, 0, 0))})
    assert {r["level"] for r in moved.collect()} == {0, 1}


def test_samples_at_edges_and_inside_cubes(spark):
    cells = grid(spark, {(x, y, z): float((x + y + z) % 2) for x in range(2) for y in range(2) for z in range(2)}).withColumn("q", F.col("x") * 10.0)
    v, _ = I.isosurface_of_levels({0: cells}, 0.5, samples=[("q", 0.0, 10.0)])
    for r in v.collect():
        assert abs(r["u_q"] - (r["px"] - 0.5)) < 1e-4
    cubes = I.complete(cells)
    at = spark.createDataFrame([(0, 0, 0, 0)], "level int, x int, y int, z int")
    got = I.interior_samples(at, cubes, cells, 0.3, 0.0, 10.0, "q").first()
    w = [1 / (I.EPSILON + abs((x + y + z) % 2 - 0.3)) for x, y, z in I.G.CORNERS]
    assert abs(got["u"] - sum(a * c[0] for a, c in zip(w, I.G.CORNERS)) / sum(w)) < 1e-4


@pytest.mark.parametrize("bad", [{"iso": float("nan")}, {"level_range": (0, 1)}, {"samples": [("v", 1.0, 1.0)]}, {"samples": [("v", 0.0, 1.0)] * 2}, {"samples": [(n, 0.0, 1.0) for n in "abc"]}])
def test_options_are_checked(spark, bad):
    cells = grid(spark, full(2, 2, 2, lambda x, y, z: float(x)))
    with pytest.raises(ValueError):
        I.isosurface_of_levels({0: cells}, **{"iso": 0.5} | bad)
