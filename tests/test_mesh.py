from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataq.operators import decimate as D
from strataq.operators import mesh as M

V, FA = "vid long, px float, py float, pz float", "fid long, a long, b long, c long"


def plane(spark, n):
    v = [(y * (n + 1) + x, float(x), float(y), 0.0) for y in range(n + 1) for x in range(n + 1)]
    f = []
    for y in range(n):
        for x in range(n):
            s = y * (n + 1) + x
            f += [(len(f), s, s + 1, s + n + 2), (len(f) + 1, s, s + n + 2, s + n + 1)]
    return spark.createDataFrame(v, V), spark.createDataFrame(f, FA)


def test_degenerate_faces(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.5, 0.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 0, 2), (2, 0, 3, 1)], FA)
    assert [r["fid"] for r in M.remove_degenerate(f, v, 0.001).collect()] == [0]
    with pytest.raises(Exception, match="vertex"):
        M.corners(spark.createDataFrame([(0, 0, 1, 99)], FA), v).collect()


def test_relax_moves_only_free_vertices(spark):
    v = spark.createDataFrame([(0, 0.2, 0.1, 0.0), (1, -1.0, -1.0, 0.0), (2, 1.0, -1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, -1.0, 1.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 3, 4), (3, 0, 4, 1)], FA)
    assert M.locked(M.edges(f)).count() == 4
    old, new = {r[0]: r[1:] for r in v.collect()}, {r[0]: r[1:] for r in M.relax(v, f).collect()}
    assert [i for i in old if old[i] != new[i]] == [0] and all(p[2] == 0 for p in new.values())
    with pytest.raises(ValueError):
        M.relax(v, f, shrink=2.0)


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_relaxation_by_blocks_is_the_passes(spark, monkeypatch, block):
    """Borders of blocks don't show, and other columns stay."""
    monkeypatch.setattr(M, "BLOCK", block)
    v, f = plane(spark, 12)
    v = v.select("vid", "px", "py", ((F.col("vid") * 7 % 5) / 8).cast("float").alias("pz"), (F.col("vid") % 3).alias("tag"))
    e = M.edges(f)
    want = v
    for _ in range(2):
        for factor in (0.5, -0.53):
            want = M.relax_pass(want, M.adjacency(e), M.locked(e), M.mean_edge_lengths(e, v), factor, 0.25)
    got = M.relax(v, f, 2)
    assert got.columns == v.columns
    a, b = ({r["vid"]: r for r in d.collect()} for d in (want, got))
    assert a.keys() == b.keys() and all(a[i]["tag"] == b[i]["tag"] and abs(a[i][p] - b[i][p]) < 1e-5 for i in a for p in M.P)
    with pytest.raises(ValueError, match="vertex"):
        M.relax(v.where("vid <> 7"), f)


def test_compaction_numbers_by_first_appearance(spark):
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], V)
    f = spark.createDataFrame([(0, 4, 2, 5), (1, 2, 4, 0)], FA)
    w, g = M.compact_vertices(v, f)
    assert sorted((r.vid, r.px) for r in w.collect()) == [(0, 4.0), (1, 2.0), (2, 5.0), (3, 0.0)]
    assert sorted(map(tuple, g.collect())) == [(0, 0, 1, 2), (1, 1, 0, 3)]
    assert M.compact_vertices(v, f.where("false"))[0].isEmpty()


def test_weld_union_dedup_validate(spark):
    v, f = plane(spark, 2)
    assert M.distinct_faces(f.unionByName(M.flip(f).withColumn("fid", F.col("fid") + 100))).count() == 8
    w, g = M.concat([(v, f), (v, f)])
    assert (w.count(), g.count()) == (18, 16) and M.validate(w, g).isEmpty()
    one = (spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "vid long, px float, py float, pz float"), spark.createDataFrame([(0, 0, 0, 0)], "fid long, a long, b long, c long"))
    w, g = M.concat([one, one, one])
    assert sorted(r["vid"] for r in w.collect()) == sorted(r["fid"] for r in g.collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="differ"):
        M.weld(v.withColumn("k", F.lit(1)), ["k"]).collect()
    assert {r["rule"] for r in M.validate(v.where("vid > 0"), f).collect()} == {"face index"}


@pytest.mark.parametrize("n", [4, 16])
def test_decimation_reaches_its_target_and_keeps_borders(spark, n):
    v, f = plane(spark, n)
    w, g, report = D.decimate(v, f, D.Options(0.5))
    assert report["reached"] and g.count() <= n * n and report["original"] == 2 * n * n
    assert M.validate(w, g).isEmpty()
    edges = Counter(r["n"] for r in M.edges(g).collect())
    assert set(edges) <= {1, 2} and edges[1] == 4 * n
    p = M.corners(g, w).select(F.sum(F.sqrt(M.area_squared()))).first()[0]
    assert abs(p - n * n) < 1e-6


def test_decimation_by_groups(spark):
    v, f = plane(spark, 24)
    w, g, report = D.decimate(v, f, D.Options(0.5, grouped_from=100, group_faces=200))
    assert report["groups"] > 1 and report["reached"] and M.validate(w, g).isEmpty()
    assert set(r["n"] for r in M.edges(g).collect()) <= {1, 2}


def sheets(spark, n, side=8):
    """n plane sheets of side x side squares, one above another: a mesh far longer than it is wide."""
    v, f = plane(spark, side)
    k, own = spark.range(n).withColumnRenamed("id", "k"), (side + 1) ** 2
    v = v.crossJoin(k).select((F.col("vid") + F.col("k") * own).alias("vid"), "px", "py", F.col("k").cast("float").alias("pz"))
    return v, f.crossJoin(k).select((F.col("fid") + F.col("k") * 2 * side * side).alias("fid"), *((F.col(c) + F.col("k") * own).alias(c) for c in "abc"))


def test_groups_of_a_long_mesh_hold_whole_pieces_of_it(spark):
    """Groups cut by shares of each side would hold single squares here, every vertex of which is on a border."""
    v, f = sheets(spark, 400)
    w, g, report = D.decimate(v, f, D.Options(0.6, grouped_from=1000, group_faces=1024))
    assert report["reached"] and report["final"] > 0.58 * report["original"] and M.validate(w, g).isEmpty()
    assert sorted(r["fid"] for r in g.select("fid").collect()) == list(range(report["final"]))
    again = D.decimate(v.repartition(3, "px"), f.repartition(5, "b"), D.Options(0.6, grouped_from=1000, group_faces=1024))[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, g.collect()))


def test_decimation_stops_at_the_error_limit_and_early(spark):
    v, f = plane(spark, 4)
    bumpy = v.withColumn("pz", (F.col("vid") % 3).cast("float"))
    assert not D.decimate(bumpy, f, D.Options(0.1, 1e-6))[2]["reached"]
    assert D.decimate(v, f, D.Options(1000.0))[2]["final"] == 32
    assert D.decimate(v, f.where("false"))[2]["final"] == 0


def test_pipeline(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 2.0, 0.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], FA)
    _, _, report = D.pipeline(v, f, options=D.Options(1.0))
    assert (report["degenerate"], report["unused"], report["final"]) == (1, 1, 1)
