import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.sources import plotfile as P
from strataq.sources import source as S
from strataq.sources.plot import AmrPlot, convert


def cube(tmp_path, values, dtype="<f8", ghost=0):
    n = 2 + 2 * ghost
    v = np.asarray(values, float).reshape(1, n, n, n)
    S.write_plotfile(str(tmp_path), [[(P.Box((0, 0, 0), (1, 1, 1)), v)]], ["density"], [P.Box((0, 0, 0), (1, 1, 1))], [(1.0, 1.0, 1.0)], ghost, dtype)
    return str(tmp_path)


@pytest.mark.parametrize("dtype", ["<f8", ">f8", "<f4", ">f4"])
def test_one_cube(spark, tmp_path, dtype):
    plot = AmrPlot.open(spark, cube(tmp_path, range(8), dtype))
    got = {(r.x, r.y, r.z): r.v for r in plot.cells().collect()}
    assert got == {(i % 2, i // 2 % 2, i // 4): float(i) for i in range(8)}
    assert plot.component("density") == 0 and plot.component("Density") is None
    assert plot.patch_bounds().first()[3:] == (0.0, 7.0)
    assert np.frombuffer(plot.raw(0, 0, 0), dtype).tolist() == list(range(8))
    plot.validate_all()
    report = convert(plot, str(tmp_path / "out"))
    assert report.pop("seconds") > 0
    assert report == {"samples": 8, "component_patches": 1, "replaced": {0: 0}}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def two_levels(tmp_path):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 6, 6, 6))
    fine = [(P.Box((2, 2, 2), (3, 5, 5)), rng.normal(size=(3, 6, 6, 4))), (P.Box((4, 2, 2), (5, 5, 5)), rng.normal(size=(3, 6, 6, 4)))]
    S.write_plotfile(str(tmp_path), [[(P.Box((0, 0, 0), (3, 3, 3)), a)], fine], ["a", "b", "c"], [P.Box((0, 0, 0), (3, 3, 3)), P.Box((0, 0, 0), (7, 7, 7))], [(1.0,) * 3, (0.5,) * 3], ghost=1)
    return a, fine


def test_levels_ghosts_and_pushdown(spark, tmp_path):
    a, fine = two_levels(tmp_path)
    plot = AmrPlot.open(spark, str(tmp_path))
    assert [tuple(r) for r in plot.levels().select("level", "nx", "rx", "ratio", "n_patches").collect()] == [(0, 4, None, None, 1), (1, 8, 2, 2, 2)]
    assert plot.translation(1) == (0, 0, 0) and plot.patches().count() == 3
    assert (plot.cells().count(), plot.cells([1], [1]).count()) == (3 * (64 + 64), 64)
    r = spark.read.format("amr").option("pushdown", "true").load(str(tmp_path)).where("component = 2 AND level = 1 AND patch_id = 1").agg(F.sum("v")).first()[0]
    assert abs(r - fine[1][1][2, 1:-1, 1:-1, 1:-1].sum()) < 1e-9
    low = spark.read.format("amr").option("component", "0").option("value_above", str(a.max() * 10)).load(str(tmp_path))
    assert low.isEmpty()
    with pytest.raises(ValueError):
        plot.cells([0, 0])


def test_values_that_cannot_be_stored(spark, tmp_path):
    plot = AmrPlot.open(spark, cube(tmp_path, [np.nan, np.inf, -np.inf, 1e300, 3, 4, 5, 6]))
    with pytest.raises(ValueError, match="4"):
        convert(plot, str(tmp_path / "x"))
    assert convert(plot, str(tmp_path / "y"), replace=True)["replaced"] == {0: 4}
    assert convert(plot, str(tmp_path / "z"), double=(0,), replace=True)["replaced"] == {0: 3}


def test_ratio():
    assert P.ratio_of((4, 6, 8), (2, 2, 2)) == (2, 3, 4)
    for bad in ((3.0, 2.0), (1.0, 2.0), (float("nan"), 1.0)):
        with pytest.raises(P.FormatError):
            P.ratio_of(bad[:1], bad[1:])


@pytest.mark.parametrize("change", [("HyperCLaw-V1.1", "HyperCLaw-V2"), ("\n3\n", "\n2\n"), ("((0,0,0) (1,1,1) (0,0,0))", "((0,0,0) (1,1) (0,0,0))"), ("0 1 0.0\n", "1 1 0.0\n")])
def test_broken_headers(tmp_path, change):
    text = open(cube(tmp_path, range(8)) + "/Header").read()
    assert change[0] in text
    with pytest.raises(P.FormatError):
        P.parse_header(text.replace(*change, 1))


@pytest.mark.parametrize("change", [("(1 0", "(1 5"), ("Cell_D_00000", "Cell_X"), ("1,1\n", "1,2\n"), ("1\n1\n1\n", "2\n1\n1\n")])
def test_broken_cell_headers(tmp_path, change):
    text = open(cube(tmp_path, range(8)) + "/Level_0/Cell_H").read()
    assert change[0] in text
    with pytest.raises(P.FormatError):
        P.parse_cell_header(text.replace(*change, 1))


def test_blocks_are_checked(tmp_path):
    path = cube(tmp_path, range(8))
    data = np.fromfile(path + "/Level_0/Cell_D_00000", np.uint8)
    box = P.Box((0, 0, 0), (1, 1, 1))
    with pytest.raises(P.FormatError):
        S.block(data[:-1], 0, box, 0, 1, 0)
    with pytest.raises(P.FormatError):
        S.block(data, 0, box, 1, 1, 0)
    with pytest.raises(P.FormatError):
        P.parse_fab(b"FAB ((8, (1 2 3 4 5 6 7 8)),(8, (8 7 6 5 4 3 2 1)))((0,0,0) (1,1,1) (0,0,0)) 1\n")


def test_series_stream(spark, tmp_path):
    from strataq.streaming import series

    rows = [(f"2024-01-01 0{h}:00:00", 0, 0, 0, 0, 0, float(h)) for h in (1, 2, 5)]
    df = spark.createDataFrame(rows, "plot_time string, level int, component int, x int, y int, z int, v double").withColumn("plot_time", F.to_timestamp("plot_time"))
    df.write.parquet(str(tmp_path / "in"))
    q = series.running_stats(series.read_series(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("series").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("series").agg(F.sum("n")).first()[0] == 2


def test_small_patches_share_a_batch():
    import numpy as np

    from strataq.sources import source

    got = source.batch(1, [(0, 7, [4, 0, 2], (2, 2, 2), 0, np.arange(8.0)), (1, 8, [0, 0, 0], (3, 1, 2), 2, np.arange(2.0, 6.0))])
    assert got.num_rows == 12 and got.column("patch_id").to_pylist() == [7] * 8 + [8] * 4
    assert [r[:3] for r in zip(*(got.column(c).to_pylist() for c in "xyz"), strict=True)][7:10] == [(5, 1, 3), (2, 0, 0), (0, 0, 1)]
