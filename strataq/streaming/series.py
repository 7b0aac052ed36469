"""A growing folder of converted cells as a stream: running component statistics (an extension; the batch operators are
operators.cells.stats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "plot_time timestamp, level int, component int, x int, y int, z int, v double"


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of Parquet files as they arrive."""
    return spark.readStream.schema(CELLS).parquet(folder)


def running_stats(cells: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Statistics by component and window of plot time; a window is given out once the watermark has passed it."""
    v = F.when(~F.isnan("v"), F.col("v"))
    grouped = cells.withWatermark("plot_time", late).groupBy(F.window("plot_time", window), "component")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.isnan("v").cast("long")).alias("nan_count"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
