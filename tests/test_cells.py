from itertools import product

import pytest
from pyspark.sql import functions as F

from strataq.functions import grid as G
from strataq.operators import cells as C
from strataq.operators import slices


def grid(spark, voxels, level=0):
    rows = [(level, *map(int, p), float(v)) for p, v in (voxels.items() if isinstance(voxels, dict) else ((p, 0.0) for p in voxels))]
    return spark.createDataFrame(rows, "level int, x int, y int, z int, v double")


def full(nx, ny, nz, value=lambda x, y, z: 0.0):
    return {(x, y, z): value(x, y, z) for x, y, z in product(range(nx), range(ny), range(nz))}


def places(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or ("x", "y", "z"))).collect())


def test_scaled_mask_removes_one_voxel(spark):
    coarse, fine = grid(spark, full(8, 8, 8)), grid(spark, [(9, 0, 0)])
    assert set(full(8, 8, 8)) - set(places(C.mask_any_cover(coarse, fine, (4, 4, 4)))) == {(2, 0, 0)}


def test_mask_with_shift(spark):
    out = C.mask_any_cover(grid(spark, full(4, 1, 1)), grid(spark, [(0, 0, 0)]), shift=(-3, 0, 0))
    assert places(out) == [(0, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_chunk_ranges_see_one_voxel_beyond(spark):
    c = grid(spark, full(34, 2, 2, lambda x, y, z: float(x >= 32)))
    got = {r["cx"]: (r["vmin"], r["vmax"]) for r in C.chunk_ranges(c).collect()}
    assert got == {0: (0.0, 1.0), 1: (1.0, 1.0)}


def test_eligible_cubes(spark):
    assert places(C.cubes(grid(spark, full(3, 2, 2))), "ax", "ay", "az") == [(0, 0, 0), (1, 0, 0)]
    holed = full(2, 2, 2)
    del holed[(1, 1, 1)]
    assert C.cubes(grid(spark, holed)).isEmpty()


def test_cubes_of_a_full_block_less_one_voxel_match_brute_force(spark):
    v = full(9, 3, 3)
    del v[(4, 1, 1)]
    want = sorted(a for a in product(range(8), range(2), range(2)) if all(tuple(p + d for p, d in zip(a, c)) in v for c in G.CORNERS))
    assert places(C.cubes(grid(spark, v)), "ax", "ay", "az") == want


def test_stats_count_nan_and_leave_it_out(spark):
    values = dict(zip(full(8, 1, 1), [float("nan"), float("inf"), float("-inf"), 3, 4, 5, 6, 7]))
    r = C.stats(grid(spark, values)).first()
    assert (r["n"], r["nan_count"], r["vmin"], r["vmax"]) == (8, 1, float("-inf"), float("inf"))
    clean = grid(spark, values).withColumn("v", G.sanitised(F.col("v")))
    assert clean.agg(F.min("v"), F.max("v")).first()[:] == (0.0, 7.0)
    assert grid(spark, values).where(~G.representable(F.col("v"), True)).count() == 3
    assert C.stats(grid(spark, values).where("false")).first()["vmin"] is None


def test_union_fill_clear_and_blocks(spark):
    a, b = grid(spark, {(0, 0, 0): 1, (1, 0, 0): 2}), grid(spark, {(1, 0, 0): 5, (9, 0, 0): 7})
    assert places(C.union_replace(a, b, (0, 0, 0), (4, 4, 4)), "x", "v") == [(0, 1.0), (1, 5.0)]
    assert places(C.fill_box(a, (1, -2, 0), (3, 1, 1), (0, 0, 0), (4, 4, 4), 9.0), "x", "v") == [(0, 1.0), (1, 9.0), (2, 9.0)]
    assert places(C.clear_box(a, (1, 0, 0), (3, 1, 1)), "x") == [(0,)]
    assert places(C.write_block(a, (1, 0, 0), (2, 1, 1), [8.0, 9.0], (0, 0, 0), (2, 4, 4)), "x", "v") == [(0, 1.0), (1, 8.0)]
    with pytest.raises(ValueError):
        C.write_block(a, (0, 0, 0), (2, 1, 1), [8.0], (0, 0, 0), (2, 4, 4))


def test_later_patches_overwrite(spark):
    w = spark.createDataFrame([(0, 0, 0, 1.0, 0), (0, 0, 0, 2.0, 3), (0, 0, 0, 9.0, 1)], "x int, y int, z int, v double, patch int")
    assert C.last_writer(w, "patch").first()["v"] == 2.0


def test_full_cover_needs_every_column(spark):
    coarse = grid(spark, [(0, 0, 0), (1, 0, 0)])
    fine = grid(spark, [(0, 0, 0), (1, 0, 1), (0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0), (2, 1, 0)])
    assert places(C.mask_full_cover(coarse, fine, "z")) == [(1, 0, 0)]
    assert places(C.mask_full_cover(coarse, fine, "z", fine_hi=(4, 2, 1))) == [(0, 0, 0), (1, 0, 0)]


def test_plane_cell_belongs_to_the_lower_cell():
    assert [slices.plane_cell(v, 0.0, 1.0, 3) for v in (0.0, 1.0, 1.25, 3.0, 3.5, -0.1)] == [0, 0, 1, 2, None, None]
    with pytest.raises(ValueError):
        slices.plane_cell(float("nan"), 0.0, 1.0, 3)


def test_slice_of_a_cube(spark):
    cells = grid(spark, full(3, 3, 3, lambda x, y, z: float(x)))
    values = slices.slice_values(cells, "x", 1.25, 1, 0.0, 1.0, [("v", 0.0, 2.0)])
    vertices, faces = slices.slice_mesh(values.withColumn("level", F.lit(0)), "x", 1.25)
    assert (faces.count(), vertices.count()) == (18, 36)
    assert vertices.agg(F.min("u"), F.countDistinct("vid"), F.max("px")).first()[:] == (0.375, 36, 1.25)


def test_slice_without_neighbour_keeps_its_value(spark):
    cells = grid(spark, {(0, 0, 0): 2.0})
    assert slices.slice_values(cells, "x", 0.25, 0, 0.0, 1.0, [("v", 0.0, 4.0)]).first()["u0"] == 0.5


def test_box_algebra(spark):
    df = spark.range(1)
    lo, hi = G.intersection([F.lit(0)] * 3, [F.lit(4)] * 3, [F.lit(2), F.lit(-1), F.lit(3)], [F.lit(9), F.lit(2), F.lit(5)])
    assert df.select(G.volume(lo, hi)).first()[0] == 2 * 2 * 1
    assert df.select(G.unorm_code(F.lit(2.0), 0.0, 1.0), G.unorm_code(F.lit(0.5), 0.0, 1.0)).first()[:] == (4294967295, 2147483648)


def test_boxes_that_hold_a_voxel(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 40, 1, 1), (2, 0, 0, 0, 3, 1, 1), (3, 33, 0, 0, 36, 2, 2)], "box_id int, lx int, ly int, lz int, hx int, hy int, hz int")
    assert sorted(r["box_id"] for r in C.any_in_boxes(boxes, grid(spark, [(35, 0, 0)])).collect()) == [1, 3]


def test_cubes_by_chunk_are_the_cubes(spark):
    """Over chunks' borders, holes and negative places."""
    cells = spark.range(40 * 5 * 5).selectExpr("1 level", "cast(id % 40 - 3 as int) x", "cast(id div 40 % 5 + 30 as int) y", "cast(id div 200 - 2 as int) z", "id * 0.5D v").where("(x + 2 * y + 3 * z) % 17 <> 0")
    want, got = ({tuple(r) for r in d.select("level", "ax", "ay", "az", *(f"v{k}" for k in range(8))).collect()} for d in (C.cubes(cells), C.cubes_by_chunk(cells, ["v"])))
    assert want == got and want
    assert {tuple(r) for r in C.cubes_by_chunk(cells, [], False).collect()} == {r[:4] for r in want}
