import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.operators import codec as C
from strataq.sources import archive

ALL = np.arange(C.VOLUME)


def pick(v, policy, index=ALL):
    codec, mask, meta, payload, error = C.encode_chunk(index, np.asarray(v, float), policy)
    i, x = C.decode_chunk(codec, C.VERSION, mask, meta, payload)
    assert (i == index).all() and len(meta) + len(payload) == C.stored_bytes(codec)
    assert error == np.abs(x - v).max() or policy.scalar != "f64"
    return codec, x


def test_choices():
    x, y, z = ALL % 32, ALL // 32 % 32, ALL // 1024
    assert pick(10 + 2 * x - 0.5 * y + 0.25 * z, C.Policy("smallest", 1e-6, scalar="f64"))[0] == 8
    assert pick((ALL * 7919 % 10000) / 10000, C.Policy("smallest", 0.002, scalar="f64"))[0] == 5
    f32 = np.random.default_rng(1).normal(size=C.VOLUME).astype(np.float32).astype(float)
    assert pick(f32, C.Policy("smallest", 0.0, scalar="f64"))[0] == 2
    assert pick(f32, C.Policy(scalar="f64"))[0] == 3
    codec, back = pick(ALL % 2, C.Policy("smallest", 0.5))
    assert codec == 1 and set(back) == {0.5}
    assert pick(np.full(C.VOLUME, 3.0), C.Policy(scalar="f64"))[0] == 1


@pytest.mark.parametrize("name", [n for n in C.IDS if n not in ("dense:u32", "dense:f64")])
def test_forced_codecs_keep_the_bound_or_fail(name):
    x = ALL % 32 * 0.5 + np.sin(ALL) * 0.01
    policy = C.Policy(name, 10.0, scalar="f64")
    codec, back = pick(x, policy)
    assert C.CODECS[codec] == name and np.abs(back - x).max() <= 10
    with pytest.raises(ValueError):
        C.encode_chunk(ALL, np.random.default_rng(2).normal(size=C.VOLUME) * 1e6, C.Policy("uniform:f64", 0.1, scalar="f64"))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(1e-6, 10), st.integers(1, 2000))
def test_error_is_bounded(seed, tolerance, count):
    rng = np.random.default_rng(seed)
    index = np.sort(rng.choice(C.VOLUME, count, replace=False))
    v = rng.normal(size=count) * rng.choice([1e-3, 1, 1e6])
    policy = C.Policy("smallest", tolerance, 1.0, scalar="f64")
    _, back = pick(v, policy, index)
    assert (np.abs(back - v) <= policy.allowed(v)).all()


def test_policies_are_checked():
    for bad in (dict(select="smallest"), dict(absolute=1.0), dict(select="nope", absolute=1.0), dict(select="smallest", absolute=1.0, relative=200), dict(scalar="unorm32"), dict(scalar="unorm32", unorm=(1.0, 1.0))):
        with pytest.raises(ValueError):
            C.Policy(**bad)
    with pytest.raises(ValueError):
        C.decode_chunk(99, 1, b"\1" + bytes(4095), b"", b"")


def test_archive(spark, tmp_path):
    rows = [(0, c, x, y, z, float(x * (c + 1)) + (0.001 * y)) for c in (0, 1) for x in range(34) for y in range(3) for z in range(2)]
    cells = spark.createDataFrame(rows, "level int, component int, x int, y int, z int, v double")
    policies = {0: C.Policy(scalar="f64"), 1: C.Policy("smallest", 0.01, scalar="f64")}
    stats = archive.write(cells, policies, str(tmp_path / "a"))
    assert [(r["component"], r["codec_id"]) for r in stats.collect()][0] == (0, 3)
    back = {(r.component, r.x, r.y, r.z): r.v for r in archive.read(spark, str(tmp_path / "a")).collect()}
    assert all(abs(back[c, x, y, z] - v) <= (0.01 if c else 0) for _, c, x, y, z, v in rows) and len(back) == len(rows)
    assert {r.component for r in archive.read(spark, str(tmp_path / "a"), [1]).select("component").distinct().collect()} == {1}
    view = archive.view(spark, str(tmp_path / "a"))
    assert archive.problems(view).isEmpty()
    assert all(r["vmax"] >= 66 for r in C.widened_ranges(view).where("component = 1 AND cx = 1").collect())
    with pytest.raises(ValueError):
        archive.read(spark, str(tmp_path / "a"), [2])
    with pytest.raises(ValueError):
        archive.write(cells, {7: C.Policy()}, str(tmp_path / "d"))
    assert {(r["cx"], r["vmin"], r["vmax"]) for r in archive.ranges(spark, str(tmp_path / "a"), 0).collect()} == {(0, 0.0, 32.002), (1, 32.0, 33.002)}
    with pytest.raises(ValueError):
        archive.transcode(spark, str(tmp_path / "a"), {0: C.Policy(scalar="f32")}, str(tmp_path / "c"))
    archive.transcode(spark, str(tmp_path / "a"), {1: C.Policy("quantized:u8", 1.0, scalar="f64")}, str(tmp_path / "b"))
    assert archive.view(spark, str(tmp_path / "b")).where("component = 1").select("codec_id").distinct().first()[0] in (1, 5)
