"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations turn unit vectors; a table's hash is the nearest signed axis. Queries probe several axes of
each table, nearest first, and candidates are ranked exactly on the original vectors.

How many tables are used and how many axes of each are probed is fitted: a bounded sample of queries is searched by brute force,
and the fewest lookups are taken that find FIT_RECALL of their neighbours. Every row is indexed, in all tables used; no bucket is capped, as crowded buckets are
searched in blocks of rows times blocks of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: So many tables at most.
TABLES, SEED = 6, 20
#: Queries (those of the least hashes) whose neighbours are searched by brute force to fit the number of probes.
FIT_QUERIES, FIT_RECALL = 64, 0.96
#: Rows and queries of one block.
BLOCK = 2048


class Rotations:
    """TABLES pseudo-rotations: three rounds of random signs and a Hadamard transform over the next power of two."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.dim, self.width = dim, 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, self.width))

    def __call__(self, x: np.ndarray, table: int) -> np.ndarray:
        """Coordinates of unit vectors along all signed axes: n rows, 2 * width columns."""
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for signs in self.signs[table]:
            y = y * signs
            h = 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.width)
                h *= 2
            y /= np.sqrt(self.width)
        return np.concatenate([y, -y], axis=1)


def matrix(column, dim: int) -> np.ndarray:
    """A list column as rows of doubles."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order wherever a row stands."""
    return (q * x).sum(axis=1)


def best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions of the k largest inner products of each query, and those as large up to rounding."""
    s = q @ x.T
    if s.shape[1] <= k:
        return np.nonzero(np.ones(s.shape, bool))
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.nonzero(s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None])


def top(df: DataFrame, k: int, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "rep")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def hashed(vectors: DataFrame, rotations: Rotations, probes: int) -> DataFrame:
    """tab, axis, rep, vec: each vector under its `probes` nearest axes of each table."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = unit(matrix(part.column(1), rotations.dim))
                for t in range(len(rotations.signs)):
                    y = rotations(x, t)
                    near = y.argmax(1)[:, None] if probes == 1 else np.argsort(-y, axis=1, kind="stable")[:, :probes]
                    row = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                    yield pa.record_batch([pa.array(np.full(near.size, t, np.int32)), pa.array(near.ravel().astype(np.int32)), part.column(0).take(row), part.column(1).take(row)], ["tab", "axis", "rep", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("rep", "vec").mapInArrow(run, f"tab int, axis int, rep long, vec {kind}")


def fit_probes(vectors: DataFrame, queries: DataFrame, rotations: Rotations, k: int) -> tuple[int, int]:
    """How many tables and probes of each find the sample's true neighbours at FIT_RECALL with the fewest lookups in all (ties: the
    fewest tables); all axes of one table find every row."""
    sample = queries.orderBy(F.xxhash64("rep"), "rep").limit(FIT_QUERIES).select("rep", "vec").toPandas()
    if not len(sample):
        return 1, 1
    ids, q = sample["rep"].to_numpy(), np.array(sample["vec"].tolist(), np.float64)
    dim = rotations.dim

    def run(batches):
        for batch in batches:
            x, reps = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            i, j = best(q, x, k + 1)
            yield pa.record_batch([pa.array(ids[i]), pa.array(reps[j]), pa.array(exact(q[i], x[j])), batch.column(1).take(pa.array(j))], ["q", "rep", "score", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    true = top(vectors.select("rep", "vec").mapInArrow(run, f"q long, rep long, score double, vec {kind}").where("q <> rep"), k, "q").toPandas()
    if not len(true):
        return 1, 1
    x = unit(np.array(true["vec"].tolist(), np.float64))
    of = pd.Series(np.arange(len(ids)), ids)[true["q"]].to_numpy()
    rank, ways = np.full(len(x), 2 * rotations.width), []
    for t in range(len(rotations.signs)):
        mine, theirs = rotations(unit(q), t), rotations(x, t).argmax(1)
        value = mine[of, theirs]
        rank = np.minimum(rank, (mine[of] > value[:, None]).sum(1) + 1)
        ways.append((int(np.sort(rank)[max(0, int(np.ceil(FIT_RECALL * len(rank))) - 1)]), t + 1))
    probes, tables = min(ways, key=lambda w: (w[0] * w[1], w[1]))
    return tables, probes


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, by inner product; ties to the smaller vec_id.
    is_query is a predicate over the column `id`.

    A query's own row is no candidate; copies of it under other ids are. Rows whose vector is null, empty, zero, of
    another size than most (ties: the longer), or holds null or non-finite components take no part, nor do rows of a null id. Repeated rows of an
    id count once for each vector. With fewer candidates than k, all that are found are returned; an empty table gives no rows.
    """
    vec = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & F.exists("vec", lambda v: v != 0))
    rows = rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 1
    rows = cut(rows.where(F.size(vec) == dim).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    # copies of a vector are searched once; of their ids only the least can be among the k nearest of anything
    few = rows.select("id", "vec").withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    vectors = cut(few.groupBy("vec").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")), "distinct")
    asking = rows.where("asks").select("id", "vec").distinct()
    who = cut(asking.join(vectors.select("vec", "rep"), "vec").select("id", "rep"), "queries")
    queries = cut(vectors.join(who.select("rep").distinct(), "rep", "left_semi"), "query-vectors")
    rotations = Rotations(dim)
    if probes is None:
        tables, probes = fit_probes(vectors, queries, rotations, k)
        rotations.signs = rotations.signs[:tables]

    index, asked = hashed(vectors, rotations, 1), hashed(queries, rotations, probes)
    count = lambda x, n: x.groupBy("tab", "axis").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    # at most TABLES times 2 * width rows, whatever the input
    blocks = F.broadcast(cut(count(index.select("tab", "axis"), "rs").join(count(asked.select("tab", "axis"), "qs"), ["tab", "axis"]), "blocks"))
    spread = lambda n, own: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    index = index.join(blocks, ["tab", "axis"]).select("tab", "axis", spread("rs", "rep").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "rep", "vec")
    asked = asked.join(blocks, ["tab", "axis"]).select("tab", "axis", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("r"), spread("qs", "rep").alias("q"), "rep", "vec")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        q, x = (np.array(list(f["vec"]), np.float64) for f in (left, right))
        i, j = best(q, x, k + 1)
        return pd.DataFrame({"query": left["rep"].to_numpy()[i], "rep": right["rep"].to_numpy()[j], "score": exact(q[i], x[j])})

    key = ["tab", "axis", "r", "q"]
    met = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(meet, "query long, rep long, score double")
    near = top(met.groupBy("query", "rep").agg(F.max("score").alias("score")), k + 1, "query")
    copies = near.join(vectors.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("rep"))
    copies = cut(top(copies, k + 1, "query"), "found")
    found = who.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(copies, "query").where("rep <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))
    out = found.select("query_id", place.cast("int").alias("rank"), F.col("rep").alias("vec_id"), "score")
    return out.where(F.col("rank") <= k)

