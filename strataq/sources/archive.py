"""Chunk archives: encoded chunks as Parquet by level and component, with their metadata beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import codec as C
from strataq.operators.cells import chunk_ranges


def write(cells: DataFrame, policies: dict[int, C.Policy], path: str, in_domain: bool = False) -> DataFrame:
    """Encodes cells (level, component, x, y, z, v) and writes them; gives the codec statistics. Components without a policy are
    stored without loss in the type of v. All components that are there get a row of the component table."""
    kind = "f32" if cells.schema["v"].dataType.simpleString() == "float" else "f64"
    there = [r[0] for r in cells.select("component").distinct().collect()]  # as many rows as there are components
    if absent := set(policies) - set(there):
        raise ValueError(f"policies for components {sorted(absent)}, of which there are no cells")
    policies = {c: C.Policy(scalar=kind) for c in there} | policies
    chunks = C.encode(cells, policies, in_domain=in_domain)
    chunks.sortWithinPartitions("level", "component", "cx", "cy", "cz").write.partitionBy("level", "component").parquet(f"{path}/chunks")
    spark = cells.sparkSession
    rows = [(c, p.scalar, p.select, p.absolute, p.relative, *(p.unorm or (None, None))) for c, p in sorted(policies.items())]
    spark.createDataFrame(rows, "component int, scalar string, select string, absolute double, relative double, low double, high double").coalesce(1).write.parquet(f"{path}/components")
    return C.codec_stats(view(spark, path))


def view(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; only the columns that a query names are read."""
    return spark.read.parquet(f"{path}/chunks")


def read(spark: SparkSession, path: str, components: list[int] | None = None) -> DataFrame:
    """Decoded cells; files of other components aren't opened."""
    chunks = view(spark, path)
    if components is not None:
        if len(set(components)) != len(components):
            raise ValueError("components must be different")
        if absent := set(components) - set(policies_of(spark, path)):
            raise ValueError(f"components {sorted(absent)} aren't in the archive")
        chunks = chunks.where(F.col("component").isin(components))
    return C.decode(chunks)


def components(spark: SparkSession, path: str) -> DataFrame:
    """component, scalar, select, absolute, relative, low, high of all stored components."""
    return spark.read.parquet(f"{path}/components")


def policies_of(spark: SparkSession, path: str) -> dict[int, C.Policy]:
    """The policies that an archive's components were written under."""
    rows = components(spark, path).collect()
    return {r["component"]: C.Policy(r["select"], r["absolute"], r["relative"], r["scalar"], None if r["low"] is None else (r["low"], r["high"])) for r in rows}


def ranges(spark: SparkSession, path: str, component: int) -> DataFrame:
    """The chunk ranges, halo included, of a component's decoded cells."""
    return chunk_ranges(read(spark, path, [component]))


def transcode(spark: SparkSession, path: str, policies: dict[int, C.Policy], target: str) -> DataFrame:
    """Decodes, works out ranges again and encodes under other policies, without loss where none is given. Scalar types and the
    bounds of normalised components stay, and values are never normalised twice."""
    old = policies_of(spark, path)
    if absent := set(policies) - set(old):
        raise ValueError(f"components {sorted(absent)} aren't in the archive")
    for c, p in policies.items():
        if (p.scalar, p.unorm) != (old[c].scalar, old[c].unorm):
            raise ValueError("transcoding keeps scalar types and their bounds")
    kept = {c: C.Policy(scalar=p.scalar, unorm=p.unorm) for c, p in old.items()}
    return write(read(spark, path), kept | policies, target, in_domain=True)


def problems(chunks: DataFrame) -> DataFrame:
    """rule, n for chunks with unknown codecs, wrong lengths, ranges that aren't ordered or finite, or that stand twice."""
    size = F.element_at(F.create_map(*(x for i in C.CODECS for x in (F.lit(i), F.lit(C.stored_bytes(i))))), F.col("codec_id"))
    rules = {
        "unknown codec": ~F.col("codec_id").isin(list(C.CODECS)) | (F.col("codec_version") != C.VERSION),
        "wrong length": F.length("metadata") + F.length("payload") != size,
        "range": ~(F.col("vmin") <= F.col("vmax")) | F.isnan("vmin") | F.isnan("vmax"),
    }
    out = chunks.select(F.explode(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))
    twice = chunks.groupBy(*C.CHUNK_COLS).count().where("count > 1").select(F.lit("twice").alias("rule"), F.lit(1).cast("long").alias("n"))
    return out.unionByName(twice.groupBy("rule").agg(F.sum("n").alias("n")))
