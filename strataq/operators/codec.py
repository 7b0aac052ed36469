"""Error-bounded chunk codecs: selection as plain aggregates, encoding and decoding as Arrow functions by chunk.

A chunk's candidates (constant, float, quantised, affine, affine with quantised residuals, dense) differ in stored bytes; the
smallest whose largest error is within the tolerance is taken, earlier ones on ties.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import grid as G

VOLUME = G.CHUNK**3
#: Codec ids and names.
CODECS = {
    1: "uniform:f64", 2: "dense:f32", 3: "dense:f64", 4: "dense:u32", 5: "quantized:u8", 6: "quantized:u16", 7: "quantized:u32",
    8: "affine:f64", 9: "affine-residual:u8", 10: "affine-residual:u16", 11: "affine-residual:u32",
}
IDS = {v: k for k, v in CODECS.items()}
VERSION = 1
CHUNK_COLS = ["level", "component", "cx", "cy", "cz"]
#: Native storage of each scalar type: codec id, numpy type.
NATIVE = {"f32": (2, "<f4"), "f64": (3, "<f8"), "unorm32": (4, "<u4")}


@dataclass(frozen=True)
class Policy:
    """select: "lossless", "smallest" or a codec's name; tolerance |x' - x| <= absolute + relative / 100 * |x| in physical units.

    unorm: (low, high) of unorm32, whose domain is [0, 1]."""

    select: str = "lossless"
    absolute: float | None = None
    relative: float = 0.0
    scalar: str = "f32"
    unorm: tuple[float, float] | None = None

    def __post_init__(self):
        if self.scalar not in NATIVE or (self.scalar == "unorm32") != (self.unorm is not None):
            raise ValueError("unknown scalar type, or unorm32 without its bounds")
        if self.unorm and not (np.isfinite(self.unorm).all() and self.unorm[1] > self.unorm[0]):
            raise ValueError("unorm bounds must be finite and rising")
        if self.select not in ("lossless", "smallest") and self.select not in IDS:
            raise ValueError(f"unknown codec {self.select}")
        if self.lossy == (self.absolute is None):
            raise ValueError("a tolerance goes with lossy codecs, and only with them")
        if self.lossy and not (0 <= self.absolute < float("inf") and 0 <= self.relative <= 100):
            raise ValueError("tolerance out of range")

    @property
    def lossy(self) -> bool:
        return self.select == "smallest" or self.select in IDS and IDS[self.select] != NATIVE[self.scalar][0]

    def allowed(self, x: np.ndarray) -> np.ndarray:
        """The largest error at domain values x, in domain units."""
        low, scale = (self.unorm[0], self.unorm[1] - self.unorm[0]) if self.unorm else (0.0, 1.0)
        return (self.absolute + self.relative / 100 * np.abs(low + scale * x)) / scale


def stored_bytes(codec: int) -> int:
    """Metadata and payload bytes of a chunk."""
    width = {2: 4, 3: 8, 4: 4, 5: 1, 6: 2, 7: 4, 9: 1, 10: 2, 11: 4}.get(codec, 0)
    return {1: 8, 8: 32}.get(codec, (16 if 5 <= codec <= 7 else 48 if codec >= 9 else 0) + VOLUME * width)


def fit_plane(index: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Least-squares coefficients of v over 1, x, y, z in the chunk; None if the points don't fix them."""
    a = np.stack([np.ones(len(index)), index % 32, index // 32 % 32, index // 1024], axis=1).astype(np.float64)
    normal = a.T @ a
    if np.linalg.matrix_rank(normal) < 4:
        return None
    c = np.linalg.solve(normal, a.T @ v)
    return c if np.isfinite(c).all() else None


def plane(index: np.ndarray, c: np.ndarray) -> np.ndarray:
    return c[0] + c[1] * (index % 32) + c[2] * (index // 32 % 32) + c[3] * (index // 1024)


def quantise(v: np.ndarray, bits: int) -> tuple[float, float, np.ndarray]:
    low, high, top = v.min(), v.max(), 2**bits - 1
    step = (high - low) / top if high > low else 0.0
    code = np.floor((v - low) / step + 0.5) if step else np.zeros(len(v))
    return float(low), float(step), np.clip(code, 0, top)


def candidates(index: np.ndarray, v: np.ndarray, policy: Policy):
    """(codec id, metadata doubles, per-voxel codes or None, reconstruction) in the order of preference."""
    ok = lambda x: bool((np.abs(x - v) <= policy.allowed(v)).all())
    wants = lambda i: policy.select in ("smallest", CODECS[i])
    native, kind = NATIVE[policy.scalar]
    if policy.select in ("lossless", "smallest", CODECS[native]):
        yield native, [], "native", v
    if not policy.lossy:
        return
    if policy.scalar != "f32" and wants(2) and native != 2 and ok(x := v.astype(np.float32).astype(np.float64)):
        yield 2, [], "f32", x
    if wants(1) and ok(x := np.full(len(v), v.min() + (v.max() - v.min()) * 0.5)):
        yield 1, [float(x[0])], None, x
    for i, bits in ((5, 8), (6, 16), (7, 32)):
        low, step, code = quantise(v, bits)
        if wants(i) and ok(x := low + code * step):
            yield i, [low, step], code, x
            break
    c = fit_plane(index, v)
    if c is None:
        return
    if wants(8) and ok(x := plane(index, c)):
        yield 8, c.tolist(), None, x
    for i, bits in ((9, 8), (10, 16), (11, 32)):
        low, step, code = quantise(v - plane(index, c), bits)
        if wants(i) and ok(x := plane(index, c) + (low + code * step)):
            yield i, [*c.tolist(), low, step], code, x
            break


def encode_chunk(index: np.ndarray, v: np.ndarray, policy: Policy) -> tuple[int, bytes, bytes, bytes, float]:
    """codec id, mask, metadata, payload, largest error of one chunk's present voxels. A chunk of one value is constant
    whatever the policy; an absent voxel's place in a payload is 0."""
    mask = np.zeros(VOLUME, bool)
    mask[index] = True
    bits = np.packbits(mask, bitorder="little").tobytes()
    if v.min() == v.max():
        return 1, bits, np.float64(v[0]).tobytes(), b"", 0.0
    found = list(candidates(index, v, policy))
    if not found:
        raise ValueError(f"codec {policy.select} cannot meet the tolerance")
    codec, meta, codes, x = min(found, key=lambda f: stored_bytes(f[0]))
    payload = b""
    if codes is not None:
        kind = {2: "<f4", 3: "<f8", 4: "<u4", 5: "<u1", 6: "<u2", 7: "<u4", 9: "<u1", 10: "<u2", 11: "<u4"}[codec]
        dense = np.zeros(VOLUME, kind)
        source = v if isinstance(codes, str) else codes
        dense[index] = np.floor(np.clip(source, 0, 1) * G.UNORM_MAX + 0.5) if codec == 4 else source
        payload = dense.tobytes()
    return codec, bits, np.array(meta, "<f8").tobytes(), payload, float(np.abs(x - v).max())


def decode_chunk(codec: int, version: int, mask: bytes, metadata: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Local indices and domain values of a chunk's present voxels."""
    if codec not in CODECS or version != VERSION:
        raise ValueError(f"unknown chunk codec {codec} version {version}")
    index = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little"))
    meta = np.frombuffer(metadata, "<f8")
    if len(metadata) + len(payload) != stored_bytes(codec) or not np.isfinite(meta).all():
        raise ValueError("a chunk's length or metadata is wrong")
    if codec == 1:
        return index, np.full(len(index), meta[0])
    if codec == 8:
        return index, plane(index, meta)
    kind = {2: "<f4", 3: "<f8", 4: "<u4", 5: "<u1", 6: "<u2", 7: "<u4", 9: "<u1", 10: "<u2", 11: "<u4"}[codec]
    code = np.frombuffer(payload, kind)[index].astype(np.float64)
    if codec in (2, 3):
        return index, code
    if codec == 4:
        return index, code / G.UNORM_MAX
    low, step = meta[-2:]
    if step < 0:
        raise ValueError("a chunk's step is negative")
    return index, low + code * step + (plane(index, meta[:4]) if codec >= 9 else 0.0)


CHUNK_SCHEMA = "level int, component int, cx int, cy int, cz int, mask binary, codec_id int, codec_version int, metadata binary, payload binary, verified_error double, allowed_error double, vmin double, vmax double"


def encode(cells: DataFrame, policies: dict[int, Policy], value: str = "v", in_domain: bool = False) -> DataFrame:
    """One row per chunk of cells (level, component, x, y, z, v). A chunk is one group of 32768 rows at most. in_domain: values
    of unorm32 components are normalised already, as decode() gives them."""
    rows = cells.select("level", "component", *G.chunk_key(), G.local_index().alias("i"), F.col(value).cast("double").alias("v"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        policy = policies.get(int(key[1]), Policy())
        pdf = pdf.sort_values("i")
        v = pdf["v"].to_numpy(np.float64)
        if policy.scalar == "f32":
            v = v.astype(np.float32).astype(np.float64)
        elif policy.unorm:
            low, high = (0.0, 1.0) if in_domain else policy.unorm
            v = np.floor(np.clip((v - low) / (high - low), 0, 1) * G.UNORM_MAX + 0.5) / G.UNORM_MAX
        codec, mask, meta, payload, error = encode_chunk(pdf["i"].to_numpy(), v, policy)
        most = float(policy.allowed(np.array([max(abs(v.min()), abs(v.max()))]))[0]) if policy.lossy else 0.0
        return pd.DataFrame([[*map(int, key), mask, codec, VERSION, meta, payload, error, most, v.min(), v.max()]], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return rows.groupBy(*CHUNK_COLS).applyInPandas(run, CHUNK_SCHEMA)


def decode(chunks: DataFrame) -> DataFrame:
    """level, component, x, y, z, v of encoded chunks, in the stored domain."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                i, v = decode_chunk(r.codec_id, r.codec_version, r.mask, r.metadata, r.payload)
                yield pd.DataFrame({"level": r.level, "component": r.component, "x": (r.cx * 32 + i % 32).astype("int32"), "y": (r.cy * 32 + i // 32 % 32).astype("int32"), "z": (r.cz * 32 + i // 1024).astype("int32"), "v": v})

    need = chunks.select(*CHUNK_COLS, "codec_id", "codec_version", "mask", "metadata", "payload")
    return need.mapInPandas(run, "level int, component int, x int, y int, z int, v double")


def codec_stats(chunks: DataFrame) -> DataFrame:
    """component, codec_id, codec_version, chunks, bytes, max_error, in order."""
    size = F.length("metadata") + F.length("payload")
    return chunks.groupBy("component", "codec_id", "codec_version").agg(F.count("*").alias("chunks"), F.sum(size).cast("long").alias("bytes"), F.max("verified_error").alias("max_error")).orderBy("component", "codec_id", "codec_version")


def widened_ranges(chunks: DataFrame) -> DataFrame:
    """Chunk ranges that hold whatever decoding gives: widened by the allowed error."""
    return chunks.select(*CHUNK_COLS, (F.col("vmin") - F.col("allowed_error")).alias("vmin"), (F.col("vmax") + F.col("allowed_error")).alias("vmax"))


# -- selection figures as aggregates -----------------------------------------------------------------------------------


def metrics(cells: DataFrame, absolute: float, value: str = "v") -> DataFrame:
    """By chunk: n, range, and the largest errors of the constant and of the 8 and 16-bit quantised forms, without Python."""
    rows = cells.select("level", *G.chunk_key(), F.col(value).cast("double").alias("v"))
    keys = ["level", "cx", "cy", "cz"]
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    joined = rows.join(span, keys)

    def error(bits: int) -> Column:
        step = (F.col("vmax") - F.col("vmin")) / float(2**bits - 1)
        code = F.when(step > 0, F.floor((F.col("v") - F.col("vmin")) / F.when(step > 0, step) + 0.5)).otherwise(0)
        return F.max(F.abs(F.col("vmin") + code * step - F.col("v")))

    middle = F.col("vmin") + (F.col("vmax") - F.col("vmin")) * 0.5
    return joined.groupBy(*keys, "n", "vmin", "vmax").agg(F.max(F.abs(middle - F.col("v"))).alias("err_uniform"), error(8).alias("err_u8"), error(16).alias("err_u16"), F.max(F.abs(F.col("v").cast("float").cast("double") - F.col("v"))).alias("err_f32"))


def choice(measured: DataFrame, absolute: float) -> DataFrame:
    """The smallest acceptable of dense f64, dense f32, constant and quantised for each chunk, earlier ones on ties."""
    options = [("dense:f64", F.lit(True)), ("dense:f32", F.col("err_f32") <= absolute), ("uniform:f64", F.col("err_uniform") <= absolute), ("quantized:u8", F.col("err_u8") <= absolute), ("quantized:u16", F.col("err_u16") <= absolute)]
    some = F.array(*(F.when(ok, F.struct(F.lit(stored_bytes(IDS[n])).alias("bytes"), F.lit(r).alias("rank"), F.lit(n).alias("codec"))) for r, (n, ok) in enumerate(options)))
    best = F.array_min(F.filter(some, lambda x: x.isNotNull()))
    return measured.select("level", "cx", "cy", "cz", best["codec"].alias("codec"), best["bytes"].cast("long").alias("bytes"))


def affine_sums(cells: DataFrame, value: str = "v") -> DataFrame:
    """By chunk, the sums of the normal equations of a plane fit."""
    lx, ly, lz = (F.col(a).bitwiseAND(F.lit(31)).cast("long") for a in "xyz")
    v = F.col(value)
    terms = {"n": F.lit(1).cast("long"), "sx": lx, "sy": ly, "sz": lz, "sxx": lx * lx, "sxy": lx * ly, "sxz": lx * lz, "syy": ly * ly, "syz": ly * lz, "szz": lz * lz, "sv": v, "svx": v * lx, "svy": v * ly, "svz": v * lz}
    return cells.groupBy("level", *G.chunk_key()).agg(*(F.sum(t).alias(n) for n, t in terms.items()))
