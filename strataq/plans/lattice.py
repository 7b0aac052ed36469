"""Deterministic volumes made of the driver's tables: 4 x 4 x 4 patches of embeddings, and a holed lattice of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x, y, z, v: each embedding is one patch, x fastest."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.selectExpr(
        "vec_id", "label", "cast(vec_id % 8 * 4 + i % 4 as int) x", "cast((vec_id div 8) % 8 * 4 + (i div 4) % 4 as int) y", "cast((vec_id div 64) * 4 + i div 16 as int) z", "v"
    )


def e_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level 1: the patches whose label isn't 0."""
    return e_all(spark, sf_dir).where("label <> 0").select(F.lit(1).alias("level"), F.col("vec_id").alias("patch_id"), "x", "y", "z", "v")


def e_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level 0: maxima over 2 x 2 x 2 voxels of all patches."""
    halves = e_all(spark, sf_dir).groupBy(*((F.shiftright(c, 1)).alias(c) for c in "xyz")).agg(F.max("v").alias("v"))
    return halves.select(F.lit(0).alias("level"), "x", "y", "z", "v")


def e_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels: level, x, y, z, v."""
    return e_fine(spark, sf_dir).drop("patch_id").unionByName(e_coarse(spark, sf_dir))


def e_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, patch_id, box and values of both levels' patches, one of each level for each embedding: the finer one of those whose
    label isn't 0. Component 0 is v, component 1 the cell's number in its patch."""
    e = read(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    half = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get("e", in_half(i, k)))))
    parts = []
    for level, n, values, some in ((0, 2, half, F.lit(True)), (1, 4, F.col("e"), F.col("label") != 0)):
        at = [(F.expr(x) * n).cast("int").alias(a) for x, a in (("vec_id % 8", "lx"), ("(vec_id div 8) % 8", "ly"), ("vec_id div 64", "lz"))]
        number = F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), lambda i: i.cast("double"))
        parts.append(e.where(some).select(F.lit(level).alias("level"), F.col("vec_id").alias("patch_id"), *at, *(F.lit(n).alias(f"n{a}") for a in "xyz"), F.array(values, number).alias("values")))
    return parts[0].unionByName(parts[1])


def in_half(i: Column, k: Column) -> Column:
    """The place in a patch of 4 x 4 x 4 of cell k of the eight in half-size cell i."""
    bit = lambda c, n: F.shiftright(c, n).bitwiseAND(F.lit(1))
    return 2 * bit(i, 0) + bit(k, 0) + 4 * (2 * bit(i, 1) + bit(k, 1)) + 16 * (2 * bit(i, 2) + bit(k, 2))


def l_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey % 40 as int) x", "cast(l_orderkey % 40 as int) y", "cast(l_linenumber - 1 as int) z", "l_extendedprice v", "l_quantity q"
    )


def l_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level 1: x, y, z, v, q, with holes of the shape of patches and single holes."""
    kept = l_all(spark, sf_dir).where("(x div 8 + 2 * (y div 8)) % 4 <> 0 AND (x * 7 + y * 13 + (z + 1) * 5) % 11 <> 0")
    return kept.groupBy("x", "y", "z").agg(F.max("v").alias("v"), F.min("q").alias("q")).select(F.lit(1).alias("level"), "x", "y", "z", "v", "q")


def l_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = l_all(spark, sf_dir).groupBy(*((F.shiftright(c, 1)).alias(c) for c in "xyz")).agg(F.max("v").alias("v"))
    return halves.select(F.lit(0).alias("level"), "x", "y", "z", "v")


#: The same volumes in DuckDB: ea, e1 (with the place in the patch), ep (both levels by patch), ef, ec, e_cells, la, lf, lc; and o, the corners of a cube.
SQL = """
e0 AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
ea AS (SELECT vec_id, label, CAST(vec_id % 8 * 4 + i % 4 AS INT) AS x, CAST((vec_id // 8) % 8 * 4 + (i // 4) % 4 AS INT) AS y,
              CAST((vec_id // 64) * 4 + i // 16 AS INT) AS z, v FROM e0),
e1 AS (SELECT vec_id, label, i, CAST(vec_id % 8 * 4 + i % 4 AS INT) AS x, CAST((vec_id // 8) % 8 * 4 + (i // 4) % 4 AS INT) AS y,
              CAST((vec_id // 64) * 4 + i // 16 AS INT) AS z, v FROM e0),
ef AS (SELECT 1 AS level, vec_id AS patch_id, x, y, z, v FROM ea WHERE label <> 0),
ec AS (SELECT 0 AS level, x // 2 AS x, y // 2 AS y, z // 2 AS z, max(v) AS v FROM ea GROUP BY x // 2, y // 2, z // 2),
ep AS (SELECT 1 AS level, vec_id AS patch_id, x, y, z, CAST(v AS DOUBLE) AS v, CAST(i AS DOUBLE) AS i FROM e1 WHERE label <> 0
  UNION ALL SELECT 0, vec_id, x // 2, y // 2, z // 2, CAST(max(v) AS DOUBLE), CAST((x // 2) % 2 + (y // 2) % 2 * 2 + (z // 2) % 2 * 4 AS DOUBLE) FROM e1 GROUP BY vec_id, x // 2, y // 2, z // 2),
e_cells AS (SELECT level, x, y, z, v FROM ef UNION ALL SELECT * FROM ec),
la AS (SELECT CAST(l_partkey % 40 AS INT) AS x, CAST(l_orderkey % 40 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, l_extendedprice AS v, l_quantity AS q FROM lineitem),
lf AS (SELECT 1 AS level, x, y, z, max(v) AS v, min(q) AS q FROM la
       WHERE (x // 8 + 2 * (y // 8)) % 4 <> 0 AND (x * 7 + y * 13 + (z + 1) * 5) % 11 <> 0 GROUP BY x, y, z),
lc AS (SELECT 0 AS level, x // 2 AS x, y // 2 AS y, z // 2 AS z, max(v) AS v FROM la GROUP BY x // 2, y // 2, z // 2),
o AS (SELECT * FROM (VALUES (0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1)) AS t(k, dx, dy, dz))
"""
