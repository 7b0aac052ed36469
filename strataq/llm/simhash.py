"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect Golay code. A
word's own codeword is the one within distance 3; its keys are that one and, if it lies at distance 3, the five codewords at
distance 4. Of two words that differ in one bit at most, the own codeword of either is among the keys of the other: if both
are not of one codeword's ball, each lies on the rim of its ball and at distance 4 from the other's centre.

Three differing bits over three segments leave either one segment equal and another with one difference at most, or one
difference in each. The first case is found under (equal segment, codeword of another), six ways; the second under the
codewords of all three. One side of the join looks up own codewords, the other keys, so no key has fewer than 33 bits.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut
from .components import components
from .jaccard import shingle_hashes

SHINGLE, MAX_BITS = 3, 3
#: Generator of the binary Golay code of length 23, dimension 12, distance 7; a fixed value.
GENERATOR = 0b110001110101
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes, in pieces, as a signed 64-bit integer; of none 0."""
    set_bits, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The text's SimHash; a text without words has 0."""
    return majority(shingle_hashes(text, size))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long) for each row; null text: 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Golay:
    """Codewords near 23-bit words, by the words' syndromes."""

    def __init__(self):
        single = []
        for i in range(23):
            r = 1 << i
            for k in range(22, 10, -1):
                if r >> k & 1:
                    r ^= GENERATOR << (k - 11)
            single.append(r)
        self.low = self.syndromes(single[:12])
        self.high = self.syndromes(single[12:])
        self.errors = np.full((2048, 6), -1, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = e = 0
                for b in bits:
                    s, e = s ^ single[b], e | 1 << b
                row = self.errors[s]
                if weight <= 3:
                    row[0] = e
                elif bin(row[0]).count("1") == 3:
                    row[np.flatnonzero(row == -1)[0]] = e

    @staticmethod
    def syndromes(single: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(single), np.int64)
        for i, r in enumerate(single):
            out[1 << i : 2 << i] = out[: 1 << i] ^ r
        return out

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each word its own codeword's index and up to five more (-1: none)."""
        e = self.errors[self.low[words & 4095] ^ self.high[words >> 12]]
        return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def table_keys(fps: np.ndarray, golay: Golay) -> tuple[list, list]:
    """(rows, keys) arrays of the looked-up side and of the looking side; a row is a position in fps."""
    bits = fps.view(np.uint64)
    seg = [((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [golay.keys(x) for x in seg]
    own = [k[:, 0] for k in near]
    rows = np.arange(len(fps))
    stored, asked = [], []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        head = (tag << 40) | seg[i] << 12
        stored.append((rows, head | own[j]))
        r, k = np.nonzero(near[j] >= 0)
        asked.append((r, head[r] | near[j][r, k]))
    head = 6 << 40
    r, k = np.nonzero(near[0] >= 0)
    stored.append((r, head | near[0][r, k] << 24 | own[1][r] << 12 | own[2][r]))
    both = (near[1][:, :, None] >= 0) & (near[2][:, None, :] >= 0)
    r, k, m = np.nonzero(both)
    asked.append((r, head | own[0][r] << 24 | near[1][r, k] << 12 | near[2][r, m]))
    return stored, asked


def keyed(fps: DataFrame, asking: bool) -> DataFrame:
    """fp, key rows of one side of the candidate join."""

    def run(batches):
        golay = Golay()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                x = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                for r, k in table_keys(x, golay)[asking]:
                    yield pa.record_batch([pa.array(x[r]), pa.array(k)], ["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """a < b (each pair once): all pairs of the distinct fingerprints in fps that differ in MAX_BITS bits or fewer.

    Spark takes either side to be as small as fps, though it has 11 or 60 rows for each, and would broadcast it through the
    driver; the hint has both shuffled."""
    stored = keyed(fps, False).select(F.col("fp").alias("a"), "key")
    asked = keyed(fps, True).select(F.col("fp").alias("b"), "key")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return stored.hint("merge").join(asked.hint("merge"), "key").where(close).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id, one row per input row.

    Rows with one fingerprint are one vertex, so copies of a text make no pairs. component_id is the least id that links
    reach; rows of a null id get one too, and it is null only where no id is reached. Null, empty and blank texts have
    fingerprint zero and link like any other. An empty table gives no rows.
    """
    rows = cut(fingerprints(df, id_col, text_col), "fingerprints")
    return classes(rows).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(rows: DataFrame) -> DataFrame:
    """rows (id, fp, ...) with component_id."""
    vertices = cut(rows.groupBy("fp").agg(F.min("id").alias("first")), "vertices")
    roots = components(links(vertices))
    linked = cut(vertices.join(roots, vertices.fp == roots.v).select("fp", "first", "root"), "linked")  # only vertices with links
    by_root = cut(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = vertices.join(linked.join(by_root, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(cut(named, "classes"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with the columns of docs: the one of the least id (a null one only if there is no
    other; of several the first read).

    Near copies share 0.8 or more of their 5-word shingles. The sets' fingerprints within MAX_BITS bits, found by the Golay
    keys above, are linked first if that holds; what three bits can't reach is found by MinHash bands (jaccard.py). A row is
    known by a key of its own here, so rows of one id or of a null id are separate documents."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    named = jaccard.groups(rows, "__row", text_col, majority, links).withColumnRenamed("row", "__row").join(rows.select("__row", F.col(id_col).alias("id")), "__row")
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("s")).select("s.__row")
    return rows.join(cut(stays, "stays"), "__row", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
