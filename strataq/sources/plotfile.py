"""Text metadata of a plotfile directory: the Header and each level's Cell_H. Small; read on the driver or in a reader task.

All text is read through Spark or Hadoop's file system where a session is given, so a plotfile may lie in any store.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
VERSION_LINE = "HyperCLaw-V1.1"
COORDINATES = ("cartesian", "cylindrical", "spherical")
FLOAT32, FLOAT64 = (32, 8, 23, 0, 1, 9, 0, 127), (64, 11, 52, 0, 1, 12, 0, 1023)
MOST_COMPONENTS, MOST_HEADER_BYTES = 2048, 4096


class FormatError(ValueError):
    """A plotfile that doesn't follow the format."""


@dataclass(frozen=True)
class Box:
    """Index box, both ends included; centring is 0 for cells, 1 for nodes."""

    lo: tuple[int, int, int]
    hi: tuple[int, int, int]
    centring: tuple[int, int, int] = (0, 0, 0)

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(h - a + 1 for a, h in zip(self.lo, self.hi, strict=True))

    def grown(self, n: int) -> Box:
        return Box(tuple(a - n for a in self.lo), tuple(a + n for a in self.hi), self.centring)

    def text(self) -> str:
        return "(" + " ".join("(" + ",".join(map(str, t)) + ")" for t in (self.lo, self.hi, self.centring)) + ")"


@dataclass
class LevelRecord:
    level: int
    patches: int
    time: float
    step: int
    boxes: list[tuple[tuple[float, ...], tuple[float, ...]]]
    path: str


@dataclass
class Header:
    variables: list[str]
    time: float
    finest: int
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    ratios: list[int]
    domains: list[Box]
    steps: list[int]
    cell_sizes: list[tuple[float, ...]]
    coordinates: int
    boundary: int
    levels: list[LevelRecord] = field(default_factory=list)


@dataclass
class PatchRecord:
    box: Box
    file: str
    offset: int


@dataclass
class CellHeader:
    mode: int
    components: int
    ghost: int
    patches: list[PatchRecord]
    minima: np.ndarray
    maxima: np.ndarray


class Lines:
    """Trimmed lines of a text, one after the other."""

    def __init__(self, text: str, what: str):
        self.lines, self.at, self.what = text.split("\n"), 0, what

    def next(self) -> str:
        if self.at >= len(self.lines):
            raise FormatError(f"{self.what} ends too early")
        self.at += 1
        return self.lines[self.at - 1].strip()

    def filled(self) -> str:
        while not (line := self.next()):
            pass
        return line

    def numbers(self, kind, count: int | None = None) -> tuple:
        try:
            out = tuple(map(kind, self.next().split()))
        except ValueError as e:
            raise FormatError(f"{self.what}, line {self.at}: {e}") from e
        if count is not None and len(out) != count:
            raise FormatError(f"{self.what}, line {self.at}: {len(out)} numbers where {count} belong")
        return out

    def one(self, kind):
        return self.numbers(kind, 1)[0]


def parse_boxes(line: str) -> list[Box]:
    """All boxes ((lo) (hi) (centring)) of a line."""
    triple = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"
    found = re.findall(rf"\(\s*{triple}\s*{triple}\s*{triple}\s*\)", line)
    boxes = [Box(*(tuple(map(int, f[i : i + 3])) for i in (0, 3, 6))) for f in found]
    rest = re.sub(rf"\(\s*{triple}\s*{triple}\s*{triple}\s*\)", "", line).strip()
    if rest or any(h < a for b in boxes for a, h in zip(b.lo, b.hi, strict=True)):
        raise FormatError(f"not an index box: {line[:80]}")
    return boxes


def parse_header(text: str) -> Header:
    r = Lines(text, "Header")
    if r.next() != VERSION_LINE:
        raise FormatError(f"Header doesn't begin with {VERSION_LINE}")
    count = r.one(int)
    if not 0 < count < MOST_COMPONENTS:
        raise FormatError(f"{count} components")
    names = [r.next() for _ in range(count)]
    if r.one(int) != 3:
        raise FormatError("only three dimensions are read")
    time, finest = r.one(float), r.one(int)
    h = Header(names, time, finest, r.numbers(float, 3), r.numbers(float, 3), list(r.numbers(int)), parse_boxes(r.next()), list(r.numbers(int)), [], 0, 0)
    if len(h.ratios) != finest or len(h.domains) != finest + 1 or len(h.steps) != finest + 1:
        raise FormatError("counts of ratios, domains or steps don't fit the number of levels")
    h.cell_sizes = [r.numbers(float, 3) for _ in range(finest + 1)]
    h.coordinates, h.boundary = r.one(int), r.one(int)
    if h.coordinates not in range(len(COORDINATES)):
        raise FormatError(f"unknown coordinate system {h.coordinates}")
    for level in range(finest + 1):
        number, patches, at = r.next().split()
        if int(number) != level:
            raise FormatError(f"level {number} where {level} belongs")
        step = r.one(int)
        boxes = []
        for _ in range(int(patches)):
            sides = [r.numbers(float, 2) for _ in range(3)]
            boxes.append(tuple(zip(*sides, strict=True)))
        h.levels.append(LevelRecord(level, int(patches), float(at), step, boxes, r.next()))
    return h


def parse_matrix(r: Lines) -> np.ndarray:
    """A dims line `rows,columns`, then rows, plain or with a comma after each number."""
    rows, columns = map(int, r.filled().split(","))
    out = []
    for _ in range(rows):
        row = [float(x) for x in r.filled().replace(",", " ").split()]
        if len(row) != columns:
            raise FormatError(f"{r.what}: {len(row)} bounds where {columns} belong")
        out.append(row)
    return np.array(out, np.float64).reshape(rows, columns)


def parse_cell_header(text: str) -> CellHeader:
    r = Lines(text, "Cell_H")
    if r.one(int) != 1:
        raise FormatError("only version 1 of Cell_H is read")
    mode = r.one(int)
    if mode not in (0, 1):
        raise FormatError(f"unknown storage mode {mode}")
    components, ghost = r.one(int), r.one(int)
    if not 0 < components < MOST_COMPONENTS or ghost < 0:
        raise FormatError("component count or ghost width out of range")
    head = re.fullmatch(r"\((\d+)\s+(\d+)", r.next())
    if not head or head[2] != "0":
        raise FormatError("box list without count or with a hash signature")
    boxes = [b for _ in range(int(head[1])) for b in parse_boxes(r.next())]
    if r.next() != ")" or len(boxes) != int(head[1]):
        raise FormatError("box list doesn't end where it should")
    count = r.one(int)
    patches = []
    for k in range(count):
        m = re.fullmatch(r"FabOnDisk:\s+(Cell_D_\d+)\s+(\d+)", r.next())
        if not m or k >= len(boxes):
            raise FormatError("not a reference to a block")
        patches.append(PatchRecord(boxes[k], m[1], int(m[2])))
    c = CellHeader(mode, components, ghost, patches, parse_matrix(r), parse_matrix(r))
    if count != len(boxes) or c.minima.shape != (count, components) or c.maxima.shape != (count, components):
        raise FormatError("counts of boxes, blocks and bounds differ")
    return c


def check(header: Header, level: int, cells: CellHeader) -> None:
    """Raises where a level's Cell_H doesn't fit the Header."""
    record = header.levels[level]
    if len(cells.patches) != record.patches or cells.components != len(header.variables):
        raise FormatError(f"level {level}: Cell_H has {len(cells.patches)} patches of {cells.components} components, Header {record.patches} of {len(header.variables)}")


def balanced(text: str) -> int:
    """Length of the balanced parenthesis at the start of a text."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i + 1
    raise FormatError("unbalanced parentheses in a block's header")


@dataclass(frozen=True)
class FabHeader:
    dtype: str
    box: Box
    components: int
    bytes: int


def parse_fab(raw: bytes) -> FabHeader:
    """The ASCII line before a block: number format, byte order, box, components."""
    end = raw[:MOST_HEADER_BYTES].find(b"\n")
    line = raw[:end].decode("ascii", "replace").strip() if end >= 0 else ""
    if not line.startswith("FAB "):
        raise FormatError("a block doesn't begin with FAB")
    line = line[4:].strip()
    cut = balanced(line)
    fmt, rest = [int(x) for x in re.findall(r"-?\d+", line[:cut])], [int(x) for x in re.findall(r"-?\d+", line[cut:])]
    n = fmt[0] if fmt else 0
    kind, order = tuple(fmt[1 : 1 + n]), fmt[2 + n :]
    width = {FLOAT32: 4, FLOAT64: 8}.get(kind)
    if width is None or len(order) != width or fmt[1 + n] != width or len(rest) != 10:
        raise FormatError("unknown number format of a block")
    if order == list(range(width, 0, -1)):
        sign = "<"
    elif order == list(range(1, width + 1)):
        sign = ">"
    else:
        raise FormatError("unknown byte order of a block")
    box = Box(tuple(rest[0:3]), tuple(rest[3:6]), tuple(rest[6:9]))
    if any(s <= 0 for s in box.shape):
        raise FormatError("a block's box is empty")
    return FabHeader(f"{sign}f{width}", box, rest[9], end + 1)


def ratio_of(coarse, fine, tolerance: float = 1e-10) -> tuple[int, ...]:
    """Refinement along each axis from cell sizes: whole numbers from 1, exact to the tolerance."""
    out = []
    for c, f in zip(coarse, fine, strict=True):
        if not (np.isfinite(c) and np.isfinite(f) and c > 0 and f > 0):
            raise FormatError("cell sizes must be finite and positive")
        r = np.floor(c / f + 0.5)
        if r < 1 or abs(c / f - r) > tolerance * r or r >= 2**32:
            raise FormatError(f"cell sizes {c} and {f} aren't in a whole ratio")
        out.append(int(r))
    return tuple(out)
