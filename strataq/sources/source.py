"""The data source "amr": cells of a plotfile, one reader task for each data file of a level.

Reads `path`; options component and level (comma-separated numbers) narrow what is read, and with option pushdown "true"
(and spark.sql.python.filterPushdown.enabled) equality filters on both do the same. Files are opened by ordinary paths: the
plotfile must be mounted where the tasks run.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from strataq.sources import plotfile as P

SCHEMA = "level int, component int, patch_id int, x int, y int, z int, v double"
#: Rows of one Arrow batch.
BATCH = 1 << 16


@dataclass
class Shard(InputPartition):
    """The patches of a level that lie in one file."""

    level: int
    file: str
    patches: list  # (patch_id, box, offset)
    origin: tuple[int, int, int]
    ghost: int
    count: int
    components: list[int]


class AmrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        many = lambda k: None if options.get(k) in (None, "") else {int(x) for x in options[k].split(",")}
        self.components, self.levels = many("component"), many("level")
        low, high = options.get("value_above"), options.get("value_below")
        self.low, self.high = (None if x is None else float(x) for x in (low, high))

    def partitions(self) -> list[Shard]:
        header = P.parse_header(open(os.path.join(self.path, "Header")).read())
        chosen = range(len(header.variables)) if self.components is None else sorted(self.components)
        if any(c not in range(len(header.variables)) for c in chosen):
            raise ValueError("no such component")
        out = []
        for record in header.levels:
            if self.levels is not None and record.level not in self.levels:
                continue
            folder = os.path.dirname(os.path.join(self.path, record.path))
            cells = P.parse_cell_header(open(os.path.join(folder, "Cell_H")).read())
            P.check(header, record.level, cells)
            domain = header.domains[record.level]
            if any(domain.centring):
                raise ValueError("only cell-centred data is read")
            files: dict[str, list] = {}
            for i, p in enumerate(cells.patches):
                if any(p.box.centring) or any(a < d or h > e for a, h, d, e in zip(p.box.lo, p.box.hi, domain.lo, domain.hi, strict=True)):
                    raise ValueError(f"patch {i} of level {record.level} isn't in its level's domain")
                if self.low is not None and all(cells.maxima[i, c] <= self.low for c in chosen) or self.high is not None and all(cells.minima[i, c] >= self.high for c in chosen):
                    continue  # the bounds show that no value of the patch can pass
                files.setdefault(p.file, []).append((i, p.box, p.offset))
            out += [Shard(record.level, os.path.join(folder, f), ps, domain.lo, cells.ghost, len(header.variables), list(chosen)) for f, ps in sorted(files.items())]
        return out

    def read(self, partition: Shard | None):
        if partition is None:  # all was pruned
            return
        data = np.memmap(partition.file, np.uint8, "r")
        held, rows = [], 0
        for patch_id, box, offset in partition.patches:
            for component in partition.components:
                values, grown = block(data, offset, box, partition.ghost, partition.count, component)
                nx, ny, nz = grown.shape
                cube = values.reshape(nz, ny, nx)
                lo = [a - g for a, g in zip(box.lo, grown.lo, strict=True)]
                size = box.shape
                v = cube[lo[2] : lo[2] + size[2], lo[1] : lo[1] + size[1], lo[0] : lo[0] + size[0]].ravel()
                at = [a - d for a, d in zip(box.lo, partition.origin, strict=True)]
                for begin in range(0, len(v), BATCH):
                    part = v[begin : begin + BATCH]
                    held.append((component, patch_id, at, size, begin, part))
                    rows += len(part)
                    if rows >= BATCH:
                        yield batch(partition.level, held)
                        held, rows = [], 0
        if held:
            yield batch(partition.level, held)


def batch(level: int, held: list) -> pa.RecordBatch:
    """Rows of pieces of patches (component, patch_id, low corner, size, number of the first cell, values): small patches share one."""
    n = np.array([len(h[5]) for h in held])
    each = lambda values: np.repeat(np.array(values, np.int32), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.array([h[4] for h in held], np.int64), n)
    nx, ny = each([h[3][0] for h in held]), each([h[3][1] for h in held])
    place = (i % nx, i // nx % ny, i // nx // ny)
    xyz = [(c + each([h[2][k] for h in held])).astype(np.int32) for k, c in enumerate(place)]
    columns = [np.full(n.sum(), level, np.int32), each([h[0] for h in held]), each([h[1] for h in held]), *xyz, np.concatenate([h[5] for h in held])]
    return pa.record_batch(list(map(pa.array, columns)), names=["level", "component", "patch_id", "x", "y", "z", "v"])


class PushingReader(AmrReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("component",), ("level",)):
                name = f"{f.attribute[0]}s"
                had = getattr(self, name)
                setattr(self, name, {f.value} if had is None else had & {f.value})
            else:
                yield f


def block(data, offset: int, box: P.Box, ghost: int, components: int, component: int) -> tuple[np.ndarray, P.Box]:
    """One component's values of a block as doubles, x fastest, ghost cells included, and their box."""
    head = P.parse_fab(bytes(data[offset : offset + P.MOST_HEADER_BYTES]))
    if head.components != components or head.box != box.grown(ghost):
        raise P.FormatError("a block doesn't fit its metadata")
    kind = np.dtype(head.dtype)
    n = int(np.prod(head.box.shape))
    start = offset + head.bytes + component * n * kind.itemsize
    if start + n * kind.itemsize > len(data):
        raise P.FormatError("a block goes beyond its file")
    return np.frombuffer(data[start : start + n * kind.itemsize], kind).astype(np.float64), head.box


class AmrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "amr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown") == "true" else AmrReader)(self.options)


@dataclass
class Written:
    """A patch as it lies in a file: its box, file and offset, and the minima and maxima of its components."""

    box: P.Box
    file: str
    offset: int
    minima: list[float]
    maxima: list[float]


def put_block(f, offset: int, box: P.Box, values: np.ndarray, ghost: int, dtype: str, file: str) -> Written:
    """Appends a block (values: components, nz, ny, nx with ghost cells) to an open file."""
    kind = np.dtype(dtype)
    fmt = P.FLOAT64 if kind.itemsize == 8 else P.FLOAT32
    order = range(kind.itemsize, 0, -1) if dtype[0] == "<" else range(1, kind.itemsize + 1)
    row = lambda t: " ".join(map(str, t))
    f.write(f"FAB ((8, ({row(fmt)})),({kind.itemsize}, ({row(order)}))){box.grown(ghost).text()} {len(values)}\n".encode())
    f.write(values.astype(kind).tobytes())
    inner = values[:, ghost : values.shape[1] - ghost, ghost : values.shape[2] - ghost, ghost : values.shape[3] - ghost]
    return Written(box, file, offset, *(g(inner, axis=(1, 2, 3)).astype(float).tolist() for g in (np.min, np.max)))


def put_metadata(path: str, levels: list[list[Written]], variables: list[str], domains: list[P.Box], sizes: list[tuple], ghost: int = 0, time: float = 0.0) -> None:
    """The Header and each level's Cell_H."""
    ratios = [P.ratio_of(a, b)[0] for a, b in zip(sizes, sizes[1:], strict=False)]
    lo, hi = (0.0, 0.0, 0.0), tuple(n * s for n, s in zip(domains[0].shape, sizes[0], strict=True))
    row = lambda t: " ".join(map(str, t))
    head = [P.VERSION_LINE, str(len(variables)), *variables, "3", str(time), str(len(levels) - 1), row(lo), row(hi), row(ratios), row(d.text() for d in domains), row([0] * len(levels)), *map(row, sizes), "0", "0"]
    for i, patches in enumerate(levels):
        head += [f"{i} {len(patches)} {time}", "0"]
        for p in patches:
            head += [f"{a * s} {(h + 1) * s}" for a, h, s in zip(p.box.lo, p.box.hi, sizes[i], strict=True)]
        head.append(f"Level_{i}/Cell")
        cell = ["1", "1", str(len(variables)), str(ghost), f"({len(patches)} 0", *(p.box.text() for p in patches), ")", str(len(patches)), *(f"FabOnDisk: {p.file} {p.offset}" for p in patches), ""]
        for bounds in ([p.minima for p in patches], [p.maxima for p in patches]):
            cell += [f"{len(patches)},{len(variables)}", *(",".join(map(repr, b)) + "," for b in bounds), ""]
        os.makedirs(f"{path}/Level_{i}", exist_ok=True)
        open(f"{path}/Level_{i}/Cell_H", "w").write("\n".join(cell) + "\n")
    open(f"{path}/Header", "w").write("\n".join(head) + "\n")


def write_plotfile(path: str, levels: list[list[tuple[P.Box, np.ndarray]]], variables: list[str], domains: list[P.Box], sizes: list[tuple], ghost: int = 0, dtype: str = "<f8", time: float = 0.0) -> None:
    """A plotfile of patches (box, values of shape components, nz, ny, nx with ghost cells) in the driver's memory; for tests."""
    written = []
    for i, patches in enumerate(levels):
        os.makedirs(f"{path}/Level_{i}", exist_ok=True)
        with open(f"{path}/Level_{i}/Cell_D_00000", "wb") as f:
            written.append([put_block(f, f.tell(), box, values, ghost, dtype, "Cell_D_00000") for box, values in patches])
    put_metadata(path, written, variables, domains, sizes, ghost, time)


def export(patches: DataFrame, path: str, variables: list[str], domains: list[P.Box], sizes: list[tuple], dtype: str = "<f8", time: float = 0.0) -> None:
    """Writes patches (level, patch_id, lx, ly, lz, nx, ny, nz, values: an array of doubles for each component, x fastest) as a
    plotfile. Each task writes files of its own in the folder, which driver and tasks share, and under a name of its own until
    they are whole, so a task may run twice. Only the patches' metadata, which the format keeps in one file, reaches the
    driver; patches are numbered by patch_id. Patches have no ghost cells here."""
    path = path.removeprefix("file://")
    for i in range(len(domains)):
        os.makedirs(f"{path}/Level_{i}", exist_ok=True)

    def run(frames):
        task = TaskContext.get()
        name, files, rows = f"Cell_D_{task.partitionId():05d}", {}, []
        for frame in frames:
            for r in frame.itertuples():
                f = files.setdefault(r.level, open(f"{path}/Level_{r.level}/.{name}-{task.taskAttemptId()}", "wb")) if r.level not in files else files[r.level]
                box = P.Box((r.lx, r.ly, r.lz), (r.lx + r.nx - 1, r.ly + r.ny - 1, r.lz + r.nz - 1))
                values = np.stack([np.asarray(v, float).reshape(r.nz, r.ny, r.nx) for v in r.values])
                w = put_block(f, f.tell(), box, values, 0, dtype, name)
                rows.append((r.level, r.patch_id, *w.box.lo, *w.box.hi, w.file, w.offset, w.minima, w.maxima))
        for level, f in files.items():
            f.close()
            os.replace(f.name, f"{path}/Level_{level}/{name}")
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])

    kinds = "level int, patch_id long, ax int, ay int, az int, bx int, by int, bz int, file string, offset long, minima array<double>, maxima array<double>"
    made = patches.select("level", "patch_id", "lx", "ly", "lz", "nx", "ny", "nz", "values").mapInPandas(run, kinds)
    levels: list[list[Written]] = [[] for _ in domains]
    for r in sorted(made.collect(), key=lambda r: (r["level"], r["patch_id"])):
        levels[r["level"]].append(Written(P.Box((r["ax"], r["ay"], r["az"]), (r["bx"], r["by"], r["bz"])), r["file"], r["offset"], r["minima"], r["maxima"]))
    put_metadata(path, levels, variables, domains, sizes, time=time)
