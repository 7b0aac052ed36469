"""What the text operators share: reading tables, cutting lineage, small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's readers touch the path, which may be remote."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), f"strataq-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What cut() has written within each scratch() that is open.
_open: list[list[str]] = []


def cut(df: DataFrame, what: str = "cut", keep: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs no recomputation.
    Within scratch() it is deleted at its end unless it is to be kept."""
    path = f"{shared_dir(df.sparkSession)}/strataq/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() has written, once nothing reads it any more."""
    delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end what cut() writes meanwhile. Results that read it must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        delete(spark, _open.pop())


#: Sets of so many ids are broadcast at most (8 MB of longs); larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, bad: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id isn't in bad (one column, distinct, null included)."""
    bad = cut(bad.toDF("__bad"), "rejected")
    some = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(some, docs[id_col].eqNullSafe(some["__bad"]), "left_anti")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often a lambda inside body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
