"""Some components of a plotfile, loaded once: cells of all levels in wide form, and what surfaces and slices derive from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import grid as G
from strataq.functions.lineage import checkpointed
from strataq.operators import cells as C
from strataq.operators import isosurface, slices
from strataq.sources import plotfile as P
from strataq.sources.plot import AmrPlot, resolve


@dataclass
class Volume:
    """cells: by level, (level, x, y, z, c0, c1, ... for the loaded components' numbers); a later patch overwrites an earlier one.

    Complete cubes and chunk ranges of a component are worked out at its first use and kept."""

    plot: AmrPlot
    components: list[int]
    cells: dict[int, DataFrame]
    derived: dict[tuple[str, int], DataFrame] = field(default_factory=dict)

    @classmethod
    def load(cls, plot: AmrPlot, components: list[int] | None = None, levels: list[int] | None = None, double: tuple[int, ...] = ()) -> Volume:
        """Values are kept as floats (those of components in `double` as doubles), 0 where they aren't finite then."""
        chosen = resolve(components, len(plot.header.variables))
        wide_kind = F.col("component").isin(list(double)) if double else F.lit(False)
        value = F.when(wide_kind, G.sanitised(F.col("v"), False)).otherwise(G.sanitised(F.col("v")).cast("double"))
        long = plot.cells(chosen, levels).withColumn("v", value)
        of = lambda c: F.max_by(F.when(F.col("component") == c, F.col("v")), F.when(F.col("component") == c, F.col("patch_id"))).alias(f"c{c}")
        wide = checkpointed(long.groupBy("level", *C.XYZ).agg(*(of(c) for c in chosen)))
        there = range(len(plot.header.levels)) if levels is None else sorted(levels)
        return cls(plot, chosen, {k: wide.where(F.col("level") == k) for k in there})

    def column(self, component: int) -> str:
        if component not in self.components:
            raise ValueError(f"component {component} isn't loaded")
        return f"c{component}"

    def whole(self, component: int) -> DataFrame:
        """level, x, y, z, v of all levels."""
        name = self.column(component)
        return _union([c.select("level", *C.XYZ, F.col(name).alias("v")) for c in self.cells.values()])

    def cubes(self, component: int) -> DataFrame:
        return self._once("cubes", component, lambda: C.cubes_by_chunk(self.whole(component), ["v"]))

    def ranges(self, component: int) -> DataFrame:
        """Value ranges of the chunks that hold the anchor of a complete cube."""
        return self._once("ranges", component, lambda: C.chunk_ranges(self.whole(component)).join(self.held(), ["level", "cx", "cy", "cz"], "left_semi"))

    def held(self) -> DataFrame:
        """level, cx, cy, cz of chunks with the anchor of a complete cube: the same for every component, as cells have all of them."""
        first = self.components[0]
        for c in self.components:
            if ("cubes", c) in self.derived:
                return self._once("held", first, lambda c=c: self.cubes(c).select("level", *G.chunk_key("ax", "ay", "az")).distinct())
        return self._once("held", first, lambda: C.cubes_by_chunk(self.whole(first), [], False).select("level", *G.chunk_key("ax", "ay", "az")).distinct())

    def _once(self, what: str, component: int, make) -> DataFrame:
        if (what, component) not in self.derived:
            self.derived[what, component] = checkpointed(make())
        return self.derived[what, component]

    def work_counts(self) -> DataFrame:
        """One row: levels, components, patches, component_patches, samples, chunks, cube_chunks (with a complete cube's anchor) and
        ranges (one for each component and such a chunk)."""
        first = self.components[0]
        patches = sum(self.plot.header.levels[k].patches for k in self.cells)
        key = F.struct("level", *G.chunk_key())
        total = self.whole(first).agg(F.count("*").alias("samples"), F.countDistinct(key).alias("chunks"))
        ranges = _union([self.ranges(c) for c in self.components])
        held = ranges.agg(F.countDistinct("level", "cx", "cy", "cz").alias("cube_chunks"), F.count("*").alias("ranges")).first()
        fixed = [F.lit(n).alias(name) for n, name in ((len(self.cells), "levels"), (len(self.components), "components"), (patches, "patches"), (patches * len(self.components), "component_patches"))]
        return total.select(*fixed, "samples", "chunks", *(F.lit(held[n]).cast("long").alias(n) for n in ("cube_chunks", "ranges")))

    def geometry(self, level: int) -> tuple:
        """Physical origin, cell size and extent of a level's own index space."""
        h = self.plot.header
        d, size = h.domains[level], h.cell_sizes[level]
        return tuple(t + a * s for t, a, s in zip(self.plot.geometry(), d.lo, size, strict=True)), size, d.shape

    def steps(self) -> dict[int, tuple]:
        h = self.plot.header
        return {k: (P.ratio_of(h.cell_sizes[k], h.cell_sizes[k + 1]), self.plot.translation(k + 1)) for k in self.cells if k + 1 in self.cells}

    def isosurface(self, component: int, iso: float, level_range: tuple[int, int] | None = None, samples: list[tuple[int, float, float]] = (), flip: bool = False) -> tuple[DataFrame, DataFrame]:
        """See isosurface_of_levels(); samples are (component, low, high)."""
        column = self.column(component)
        named = [(self.column(c), low, high) for c, low, high in samples]
        sizes = {k: self.geometry(k)[:2] for k in self.cells}
        return isosurface.isosurface_of_levels(self.cells, iso, column, sizes, self.steps(), level_range, named, flip, self.cubes(component), self.ranges(component))

    def slice(self, axis: str, plane: float, values: list[tuple[int, float, float]], level_range: tuple[int, int] | None = None, flip: bool = False) -> tuple[DataFrame, DataFrame]:
        """See slice_of_levels(); values are (component, low, high)."""
        if not math.isfinite(plane):
            raise ValueError("the plane's value must be finite")
        named = [(self.column(c), low, high) for c, low, high in values]
        return slices.slice_of_levels(self.cells, axis, plane, {k: self.geometry(k) for k in self.cells}, named, self.steps(), level_range, flip)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
