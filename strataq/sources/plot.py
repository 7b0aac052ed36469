"""A plotfile as DataFrames: metadata tables, cells, and conversion to a Parquet dataset."""

from __future__ import annotations

import math
import os
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import grid as G
from strataq.sources import plotfile as P
from strataq.sources.source import AmrSource

XYZ = ("x", "y", "z")


@dataclass
class AmrPlot:
    spark: SparkSession
    path: str
    header: P.Header

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AmrPlot:
        """Reads the Header; levels' Cell_H are read when they are needed."""
        path = path.removeprefix("file://")
        return cls(spark, path, P.parse_header(open(os.path.join(path, "Header")).read()))

    def cell_header(self, level: int) -> P.CellHeader:
        record = self.header.levels[level]
        cells = P.parse_cell_header(open(os.path.join(os.path.dirname(os.path.join(self.path, record.path)), "Cell_H")).read())
        P.check(self.header, level, cells)
        return cells

    def validate_all(self) -> None:
        for record in self.header.levels:
            self.cell_header(record.level)

    def component(self, name: str) -> int | None:
        """The number of a variable, by its exact name."""
        return self.header.variables.index(name) if name in self.header.variables else None

    def plot_header(self) -> DataFrame:
        h = self.header
        return self.spark.createDataFrame([(h.time, h.finest, *h.lo, *h.hi, h.coordinates, h.boundary)], "time double, finest_level int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, coord_sys int, boundary_width int")

    def variables(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.header.variables)), "component int, name string")

    def levels(self) -> DataFrame:
        """One row a level: index origin, extent, cell size, ratio to the level before (as declared, and by axis from cell sizes)."""
        h, rows = self.header, []
        for i, r in enumerate(h.levels):
            d = h.domains[i]
            if any(d.centring):
                raise P.FormatError("only cell-centred data is read")
            ratios = P.ratio_of(h.cell_sizes[i - 1], h.cell_sizes[i]) if i else (None,) * 3
            rows.append((i, *d.lo, *d.shape, *h.cell_sizes[i], h.ratios[i - 1] if i else None, *ratios, r.step, r.time, r.patches, r.path))
        kinds = ["level int", *(f"o{a} int" for a in XYZ), *(f"n{a} int" for a in XYZ), *(f"d{a} double" for a in XYZ), "ratio int", *(f"r{a} int" for a in XYZ), "step long", "time double", "n_patches int", "path string"]
        return self.spark.createDataFrame(rows, ", ".join(kinds))

    def translation(self, fine: int) -> tuple[int, ...]:
        """t with fine = coarse * ratio + t in level-local cells."""
        c, f = self.header.domains[fine - 1], self.header.domains[fine]
        r = P.ratio_of(self.header.cell_sizes[fine - 1], self.header.cell_sizes[fine])
        return tuple(a * k - b for a, k, b in zip(c.lo, r, f.lo, strict=True))

    def geometry(self) -> tuple[float, ...]:
        """Translation of the affine map of global indices: domain minimum less origin times cell size, of level 0."""
        h = self.header
        return tuple(m - o * s for m, o, s in zip(h.lo, h.domains[0].lo, h.cell_sizes[0], strict=True))

    def patches(self, level: int | None = None) -> DataFrame:
        """level, patch_id, box (level-local, half open), file, offset, ghost."""
        rows = []
        for r in self.header.levels if level is None else [self.header.levels[level]]:
            c, o = self.cell_header(r.level), self.header.domains[r.level].lo
            for i, p in enumerate(c.patches):
                rows.append((r.level, i, *(a - b for a, b in zip(p.box.lo, o, strict=True)), *(a - b + 1 for a, b in zip(p.box.hi, o, strict=True)), *r.boxes[i][0], *r.boxes[i][1], p.file, p.offset, c.ghost))
        kinds = ["level int", "patch_id int", *(f"l{a} int" for a in XYZ), *(f"h{a} int" for a in XYZ), *(f"plo_{a} double" for a in XYZ), *(f"phi_{a} double" for a in XYZ), "data_file string", "data_offset long", "ghost int"]
        return self.spark.createDataFrame(rows, ", ".join(kinds))

    def patch_bounds(self) -> DataFrame:
        rows = []
        for r in self.header.levels:
            c = self.cell_header(r.level)
            rows += [(r.level, i, k, float(c.minima[i, k]), float(c.maxima[i, k])) for i in range(len(c.patches)) for k in range(c.components)]
        return self.spark.createDataFrame(rows, "level int, patch_id int, component int, vmin double, vmax double")

    def cells(self, components: list[int] | None = None, levels: list[int] | None = None) -> DataFrame:
        """level, component, patch_id, x, y, z, v: valid cells only, in level-local places; overlapping patches both show."""
        self.spark.dataSource.register(AmrSource)
        chosen = resolve(components, len(self.header.variables))
        r = self.spark.read.format("amr").option("component", ",".join(map(str, chosen)))
        if levels is not None:
            r = r.option("level", ",".join(map(str, levels)))
        if self.spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true":
            r = r.option("pushdown", "true")
        return r.load(self.path)

    def cells_of(self, *names: str, levels: list[int] | None = None) -> DataFrame:
        """cells() of components by their exact names."""
        if unknown := [n for n in names if self.component(n) is None]:
            raise ValueError(f"no variables {unknown}")
        return self.cells([self.component(n) for n in names], levels)

    def raw(self, level: int, patch_id: int, component: int) -> bytes:
        """One component's values of a patch as they lie in the file, ghost cells included."""
        patch = self.cell_header(level).patches[patch_id]
        folder = os.path.dirname(os.path.join(self.path, self.header.levels[level].path))
        with open(os.path.join(folder, patch.file), "rb") as f:
            f.seek(patch.offset)
            head = P.parse_fab(f.read(P.MOST_HEADER_BYTES))
            n = math.prod(head.box.shape) * np.dtype(head.dtype).itemsize
            f.seek(patch.offset + head.bytes + component * n)
            return f.read(n)

    def describe(self) -> DataFrame:
        return self.levels().select("level", "nx", "ny", "nz", "n_patches", "step", "time")


def resolve(components: list[int] | None, count: int) -> list[int]:
    """Checked component numbers; none given means all."""
    if not components:
        return list(range(count))
    if len(set(components)) != len(components) or not all(0 <= c < count for c in components):
        raise ValueError("components must be different and there")
    return list(components)


def convert(plot: AmrPlot, target: str, components: list[int] | None = None, double: tuple[int, ...] = (), replace: bool = False) -> dict:
    """Writes cells as Parquet by level and component, sorted by chunk within files, and gives a report.

    Values that aren't finite, or not as floats where floats are stored (components in `double` stay doubles), are an error
    unless replace puts 0 for them. Later patches overwrite earlier ones. Only Cartesian plotfiles are converted."""
    began = time.monotonic()
    if plot.header.coordinates != 0:
        raise ValueError("only Cartesian data is converted")
    chosen = resolve(components, len(plot.header.variables))
    wide = F.col("component").isin(list(double)) if double else F.lit(False)
    cells = plot.cells(chosen)
    bad = ~F.when(wide, G.representable(F.col("v"), False)).otherwise(G.representable(F.col("v"), True))
    report = cells.groupBy("component").agg(F.count("*").alias("samples"), F.sum(bad.cast("long")).alias("replaced"), F.countDistinct("level", "patch_id").alias("patches")).collect()
    if not replace and any(r["replaced"] for r in report):
        raise ValueError("values that can't be stored: " + ", ".join(f"component {r['component']}: {r['replaced']}" for r in report if r["replaced"]))
    value = F.when(bad, F.lit(0.0)).when(wide, F.col("v")).otherwise(F.col("v").cast("float").cast("double"))
    last = cells.withColumn("v", value).groupBy("level", "component", "x", "y", "z").agg(F.max_by("v", "patch_id").alias("v"))
    out = last.withColumns(dict(zip(("cx", "cy", "cz"), G.chunk_key(), strict=True))).repartition("level", "component", "cz", "cy").sortWithinPartitions("cz", "cy", "cx", "z", "y", "x")
    out.write.partitionBy("level", "component").parquet(target)
    return {"samples": sum(r["samples"] for r in report), "component_patches": sum(r["patches"] for r in report), "replaced": {r["component"]: r["replaced"] for r in report}, "seconds": time.monotonic() - began}
