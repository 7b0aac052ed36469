"""Near copies by word shingles: MinHash bands find candidates, the exact Jaccard similarity of the shingle sets decides.

A pair of similarity 0.8 shares one of BANDS bands with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.99993 here;
pairs above it are missed more rarely still. No pair below 0.8 is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SEED = 42
#: Words of a shingle, and the least similarity of near copies: LEAST[0] / LEAST[1].
SHINGLE, LEAST = 5, (4, 5)
BANDS, ROWS = 24, 5
#: Odd factors; h * factor modulo 2 ** 64 orders the shingles anew. Fixed values.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The sketches (four bits of each minimum) of a pair at 0.8 differ in more than UNLIKE places with a probability of 0.000008.
UNLIKE = 42
#: Sets of so many shingles are compared inside the join.
SMALL = 256
#: Under a key with more vertices than CROWD each meets one of them in each of so many rounds, before those left unlinked meet.
CROWD, ROUNDS = 32, 2


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """xxHash64 of each run of `size` lower-cased words, in pieces; of all words together if they are fewer. No words: nothing."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: len(words) - size] + 1].tolist()
    ends = ends[size - 1 :].tolist()
    for lo in range(0, len(starts), 1 << 15):
        parts = [joined[s:e] for s, e in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)], strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def shingle_set(text: str) -> np.ndarray:
    """The text's shingle hashes, each once, rising."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, SHINGLE)]))


def digest(shingles: np.ndarray) -> int:
    """The set's hash as a signed 64-bit integer: the vertex of all texts with that set."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles in each order."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, lo : lo + 1024] * FACTORS[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band of a set's minima."""
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> list[int]:
    """Four bits of each minimum, sixteen of them in a long."""
    bits = (least >> np.uint64(20) & np.uint64(15)).astype(np.uint8)
    bits = np.r_[bits, np.zeros(-len(bits) % 16, np.uint8)]
    return (bits[::2] | bits[1::2] << 4).view("<i8").tolist()


def may_be_near() -> Column:
    """Whether two sketches (sketch, sketch2) differ in UNLIKE minima or fewer."""
    unlike = F.lit(0)
    for i in range(-(-BANDS * ROWS // 16)):
        x = F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return unlike <= UNLIKE


def sketches(rows: DataFrame, row_col: str, text_col: str, fingerprint: Callable) -> DataFrame:
    """row, v (digest), n (size of the set), fp (fingerprint of the set), keys of its bands and sketch for each row; null text
    counts as empty. The empty set has no keys."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(map(f, sets), pa.int64()) for f in (digest, len, lambda s: fingerprint([s]))]
            least = [minima(s) for s in sets]
            columns += [pa.array((f(x) if len(s) else [] for s, x in zip(sets, least, strict=True)), pa.list_(pa.int64())) for f in (band_keys, sketch)]
            yield pa.record_batch([batch.column(0), *columns], ["row", "v", "n", "fp", "keys", "sketch"])

    return rows.select(row_col, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "row long, v long, n long, fp long, keys array<long>, sketch array<long>")


def sets_of(some: DataFrame, vertices: DataFrame, rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """v, shingles (bytes) for the vertices in some (v, distinct); each set is made again from the text of one row."""
    texts = rows.join(vertices.join(some, "v", "left_semi").select(F.col("row").alias(row_col)), row_col, "left_semi")

    def load(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():  # sets are long, so one by one
                s = shingle_set(t)
                yield pa.record_batch([pa.array([digest(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["v", "shingles"])

    return cut(texts.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(load, "v long, shingles binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: vertices) whose sets are similar enough."""

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0])
            yield pa.record_batch([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sets = sets.join(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct(), "v", "left_semi")
    met = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def small_sets(sets: DataFrame) -> DataFrame:
    """v, small: the set as an array, of sets of SMALL shingles at most."""

    def run(batches):
        for batch in batches:
            small = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(small, pa.list_(pa.int64()))], ["v", "small"])

    few = sets.where(F.octet_length("shingles") <= 8 * SMALL).select("v", "shingles")
    return cut(few.mapInArrow(run, "v long, small array<long>"), "small-sets")


def small_and_far() -> Column:
    """Whether small and small2 are there and have less than the least similarity."""
    both = F.size(F.array_intersect("small", "small2")) * (LEAST[0] + LEAST[1])
    return F.col("small").isNotNull() & F.col("small2").isNotNull() & (both < (F.col("n") + F.col("n2")) * LEAST[0])


def paired(left: DataFrame, right: DataFrame, where: Column, last: Column | None = None) -> DataFrame:
    """a < b, each once: vertices of left (key, v, n, sketch, ...) and right (the same names with a 2 behind) under one key,
    whose sizes and sketches allow the least similarity. The join compares them, so no other pair is made."""
    sizes = F.least("n", "n2") * LEAST[1] >= F.greatest("n", "n2") * LEAST[0]
    where = where & sizes & may_be_near()
    met = left.join(right, (F.col("key") == F.col("key2")) & (F.col("v") != F.col("v2")) & (where if last is None else where & last))
    return met.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()


def renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"{c}2" for c in df.columns))


class Links:
    """The pairs (a < b: vertices) verified so far, those among them that are similar enough, and the components these make."""

    def __init__(self, sets: DataFrame):
        self.sets, self.tried, self.found, self.roots = sets, None, None, None

    def check(self, pairs: DataFrame) -> None:
        pairs = cut(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        good = verified(pairs, self.sets)
        self.tried, self.found = (pairs, good) if self.tried is None else (self.tried.union(pairs), self.found.union(good))
        self.roots = components(self.found)

    def label(self, members: DataFrame) -> DataFrame:
        """members with the label of each vertex v: its component, or itself."""
        if self.roots is None:
            return members.withColumn("label", F.col("v"))
        return members.join(self.roots.withColumnRenamed("root", "label"), "v", "left").withColumn("label", F.coalesce("label", "v"))


def shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, v) whose key has others, with their number (size)."""
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return cut(keyed.join(several, "key"), "shared")


def link(links: Links, keyed: DataFrame, vertices: DataFrame) -> None:
    """Verifies pairs of vertices (v, n, sketch) under one key of keyed (key, v, size) till each pair left out lies within one component.

    First each vertex meets one of its key, under keys of more than CROWD vertices another one in each of ROUNDS; then all
    pairs of unlike labels that are left meet. Sets of SMALL shingles at most are compared inside that last join, as a crowd
    of texts a little less alike would make pairs with the square of its size."""
    members = keyed.join(vertices.select("v", "n", "sketch"), "v")
    unlike = F.col("label") != F.col("label2")
    for i in range(ROUNDS + 1):
        members = cut(links.label(members), "members")
        least = F.min(F.struct(F.xxhash64("v", F.lit(i)).alias("h"), "v", "n", "sketch", "label")).alias("s")
        apart = cut(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("size").alias("size"), least).where("low <> high"), "apart")
        members = cut(members.join(apart.select("key"), "key", "left_semi"), "members")
        meet = apart.where(F.col("size") > (CROWD if i else 1))
        if i == ROUNDS or meet.isEmpty():
            break
        links.check(paired(members, renamed(meet.select("key", "s.v", "s.n", "s.sketch", "s.label")), unlike))
        members = members.drop("label")
    if members.isEmpty():
        return
    # of two vertices with unlike labels one at least isn't of its key's largest component
    by_label = members.groupBy("key", "label").count()
    largest = by_label.groupBy("key").agg(F.max(F.struct("count", "label")).alias("s")).select("key", F.col("s.label").alias("main"))
    members = members.join(small_sets(links.sets.join(members.select("v").distinct(), "v", "left_semi")), "v", "left")
    others = members.join(largest, "key").where("label <> main").drop("main")
    links.check(paired(others, renamed(members), unlike, ~small_and_far()))


def near_keys(vertices: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, v: a key for each fingerprint and for each two that near() finds, with all vertices of these."""
    close = cut(near(vertices.select("fp").distinct()), "close")
    pair = close.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    return vertices.select(F.col("fp").alias("key"), "v").union(pair.join(vertices, "fp").select("key", "v"))


def groups(rows: DataFrame, row_col: str, text_col: str, fingerprint: Callable, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """row, root for each row: rows with one root are near copies of each other, if only through others.

    Candidates are first the vertices whose fingerprints (of their shingle hashes) near() finds close, then those that share
    a MinHash band and aren't linked yet; each link is verified."""
    made = cut(sketches(rows, row_col, text_col, fingerprint), "sketches")
    first = made.groupBy("v").agg(F.min("row").alias("row"))
    vertices = cut(made.join(first.select("row"), "row", "left_semi"), "vertices")
    keyed = [shared(near_keys(vertices, near)), shared(vertices.select(F.explode("keys").alias("key"), "v"))]
    links = Links(sets_of(keyed[0].select("v").union(keyed[1].select("v")).distinct(), vertices, rows, row_col, text_col))  # texts are shuffled this once
    for some in keyed:
        link(links, some, vertices)
    return links.label(made.select("row", "v")).select("row", F.col("label").alias("root"))
