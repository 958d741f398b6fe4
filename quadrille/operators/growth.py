"""Boxes of likely tables in raw sheets: cells that stand close together, refined by headers and density.

The rules follow the intent of the published heuristics (grow regions at several gap
widths, test headers by their wording, trim sparse edges, resolve overlaps) in a design
of their own on arrays; boxes needn't equal those of other implementations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import character_ratios
from .encode import boundaries
from .kernels import numbers, per_batch, squeezed
from .tables import component_runs

#: Gaps (across, down) at which regions grow.
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1))
#: Lines that stay of a run of empty ones: more than any gap, so that no region reaches over what is left out.
APART = 1 + max(max(g) for g in GAPS)
#: Places of the sheets that stand in one array; a sheet with more has one of its own.
PLACES = 1 << 18
#: Letters weigh this much against a text's length in the test of wording; a row's share is of at least this part of its places.
WORDY, LEAST_FILLED = 2.5, 1 / 3
#: Marks of cells that show borders and fills.
EDGES = ("TopBorder", "BottomBorder", "LeftBorder", "RightBorder")

#: What kernels get of each cell.
MARKS = ("full", "marked", "header_like")

Box = tuple[int, int, int, int]


def cell_values(cells: DataFrame, attributes: str | None = None) -> DataFrame:
    """Cells with what detection weighs: content 2, borders 2 for each (three or four sides count one less), fill 2, all at most 16; and header_like."""
    full = F.trim(F.coalesce("v", F.lit(""))) != ""
    attrs = F.coalesce(F.col(attributes), F.array().cast("array<string>")) if attributes else F.array().cast("array<string>")
    sides = F.size(F.filter(attrs, lambda a: a.isin(*EDGES)))
    ratios = character_ratios(F.trim("v"))
    wordy = (ratios["alpha"] > 0) & ((ratios["alpha"] >= ratios["digit"]) | (ratios["alpha"] * F.length(F.trim("v")) > WORDY)) | (ratios["special"] > 0)
    x = cells.withColumns({"content": F.when(full, 2).otherwise(0), "border": F.when(sides >= 3, sides - 1).otherwise(sides) * 2, "fill": F.when(F.array_contains(attrs, "FillColor"), 2).otherwise(0), "header_like": full & F.coalesce(wordy, F.lit(False))})
    return x.withColumn("value", F.least(F.lit(16), F.col("content") + F.col("border") + F.col("fill")))


def boundary_lines(grid: DataFrame, axis: str = "r") -> DataFrame:
    """(sheet_id, i, n): lines of a dense grid of ``cell_values`` after which the value changes in n cells."""
    return boundaries(grid.withColumn("value", F.coalesce("value", F.lit(0))), "value", axis)


def closed(mask: np.ndarray, gap: int) -> np.ndarray:
    """A mask whose rows have inner gaps of up to ``gap`` cells filled."""
    at = np.flatnonzero(mask)
    near = np.flatnonzero((np.diff(at) > 1) & (np.diff(at) <= gap + 1) & (at[1:] // mask.shape[1] == at[:-1] // mask.shape[1]))
    steps = np.zeros(mask.size + 1, np.int8)
    steps[at[near]] += 1
    steps[at[near + 1]] -= 1
    return mask | (np.cumsum(steps[:-1], dtype=np.int8) > 0).reshape(mask.shape)


@dataclass
class Sheet:
    """Arrays of one sheet: content, borders, fills, header-like cells, and sums of content."""

    full: np.ndarray
    marked: np.ndarray
    header: np.ndarray

    def __post_init__(self):
        self.sums = np.pad(self.full.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        self.any_marked, self.any_header = bool(self.marked.any()), bool(self.header.any())

    def count(self, r0: int, c0: int, r1: int, c1: int) -> int:
        h, w = self.full.shape
        r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, h - 1), min(c1, w - 1)
        if r0 > r1 or c0 > c1:
            return 0
        s = self.sums.item
        return s(r1 + 1, c1 + 1) - s(r0, c1 + 1) - s(r1 + 1, c0) + s(r0, c0)

    def density(self, b: Box) -> float:
        return self.count(*b) / ((b[2] - b[0] + 1) * (b[3] - b[1] + 1))

    def trimmed(self, b: Box) -> Box | None:
        """The box without empty lines at its edges."""
        part = self.full[b[0] : b[2] + 1, b[1] : b[3] + 1]
        r, c = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
        return (b[0] + int(r[0]), b[1] + int(c[0]), b[0] + int(r[-1]), b[1] + int(c[-1])) if len(r) else None

    def regions(self, across: int, down: int, borders: bool) -> list[Box]:
        """Boxes of cells that connect over gaps of less than ``across`` columns or ``down`` rows."""
        base = self.full | self.marked if borders else self.full
        row, first, end, number = component_runs(closed(base, across - 1) | closed(base.T, down - 1).T)
        if not len(row):
            return []
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
        edges = [f.reduceat(x[order], cuts) for f, x in ((np.minimum, row), (np.minimum, first), (np.maximum, row), (np.maximum, end - 1))]
        several = edges[2] > edges[0]
        boxes = zip(*[x[several].tolist() for x in edges])
        if not (borders and self.any_marked):
            return list(boxes)  # every edge of a region of content has content
        return [b for b in map(self.trimmed, boxes) if b and b[2] > b[0]]

    def header_share(self, r: int, c0: int, c1: int) -> float:
        """Header-like cells of a row over its filled ones, or a third of all if fewer are filled."""
        n = max(self.count(r, c0, r, c1), (c1 - c0 + 1) * LEAST_FILLED)
        return float(self.header[r, c0 : c1 + 1].sum() / n)

    def is_header(self, r: int, c0: int, c1: int) -> bool:
        """A row that is well filled with wording, unlike the row below it."""
        if not self.any_header or c0 == c1 or not 0 <= r < len(self.full):
            return False
        filled = self.count(r, c0, r, c1) / (c1 - c0 + 1)
        below = self.header_share(r + 1, c0, c1) if r + 1 < len(self.full) else 0.0
        return filled > 0.3 and self.header_share(r, c0, c1) > 0.4 and (below < 0.9 or filled > 0.6)

    def acceptable(self, b: Box) -> bool:
        """Two rows and columns at least, some content on every edge, and not mostly empty."""
        r0, c0, r1, c1 = b
        if r1 <= r0 or c1 <= c0:
            return False
        edges = (self.count(r0, c0, r0, c1), self.count(r1, c0, r1, c1), self.count(r0, c0, r1, c0), self.count(r0, c1, r1, c1))
        return min(edges) > 0 and self.density(b) >= (0.3 if (r1 - r0 + 1) * (c1 - c0 + 1) < 24 else 0.1)

    def refined(self, b: Box) -> Box | None:
        """Sparse titles above a header go; a header up to two rows above joins."""
        r0, c0, r1, c1 = b
        for r in range(r0, min(r0 + 4, r1)):
            if self.is_header(r, c0, c1):
                r0 = r
                break
            if self.count(r, c0, r, c1) > max(1, (c1 - c0 + 1) // 4):
                break
        for step in (1, 2):
            if not self.is_header(r0, c0, c1) and self.is_header(r0 - step, c0, c1) and self.count(r0 - step, c0, r0 - 1, c1):
                r0 -= step
                break
        while r1 > r0 + 1 and self.count(r1, c0, r1, c1) <= 1 and self.count(r1 - 1, c0, r1 - 1, c1) <= 1 < c1 - c0:
            r1 -= 1
        return self.trimmed((r0, c0, r1, c1))

    def rank(self, b: Box) -> tuple:
        """Boxes with a header first, then the more cells they hold, weighed by how full they are."""
        return (self.is_header(b[0], b[1], b[3]), self.count(*b) * self.density(b) ** 0.5, -b[0], -b[1])

    def candidates(self) -> set[Box]:
        found: set[Box] = set()
        seen: set[Box] = set()
        for across, down in GAPS:
            for borders in (True, False) if self.any_marked else (True,):
                for b in self.regions(across, down, borders):
                    if b in seen or b[3] == b[1]:  # refining only takes columns away
                        continue
                    seen.add(b)
                    better = self.refined(b)
                    found |= {x for x in (b, better) if x and self.acceptable(x)}
        return found

    def disjoint(self, found: set[Box] | list[Box]) -> list[Box]:
        """The best of the boxes that overlap, from the top left."""
        kept: list[Box] = []
        for b in sorted(found, key=self.rank, reverse=True):
            if all(b[2] < k[0] or k[2] < b[0] or b[3] < k[1] or k[3] < b[1] for k in kept):
                kept.append(b)
        return sorted(kept)

    def boxes(self) -> list[Box]:
        return self.disjoint(self.candidates())


def stacked_boxes(ids: np.ndarray, cuts: np.ndarray, given: dict):
    """Columns (id, idx, r0, c0, r1, c1) of the boxes of some sheets, as many at a time as have ``PLACES``."""
    r, c, *marks = (numbers(given[n]) for n in ["r", "c", *MARKS])
    lines = []
    for a, b in zip(cuts, cuts[1:]):
        lines.append((squeezed(r[a:b], APART), squeezed(c[a:b], APART)))
    high, wide = (np.array([len(x[i][1]) for x in lines]) for i in (0, 1))
    at = 0
    while at < len(ids):
        end = at + 1  # as many sheets as make no more than so many places
        while end < len(ids) and (high[at : end + 1] + APART).sum() * wide[at : end + 1].max() <= PLACES:
            end += 1
        top = np.cumsum(high[at:end] + APART) - high[at:end] - APART
        rows = np.concatenate([x[0][0] + t for x, t in zip(lines[at:end], top)])
        columns = np.concatenate([x[1][0] for x in lines[at:end]])
        grids = [np.zeros((int(top[-1] + high[end - 1]), int(wide[at:end].max())), bool) for _ in MARKS]
        for g, m in zip(grids, marks):
            g[rows, columns] = m[cuts[at] : cuts[end]]
        sheet = Sheet(*grids)
        found: dict[int, list[Box]] = {}
        for b in sheet.candidates():
            found.setdefault(int(np.searchsorted(top, b[0], "right")) - 1, []).append(b)
        out = []
        for k in sorted(found):
            (_, own_r), (_, own_c) = lines[at + k]
            for i, (r0, c0, r1, c1) in enumerate(sheet.disjoint(found[k])):
                out.append((ids[at + k], i, own_r[r0 - top[k]], own_c[c0], own_r[r1 - top[k]], own_c[c1]))
        if out:
            yield list(np.array(out, np.int64).T)
        at = end


def detect_boxes(cells: DataFrame, attributes: str | None = None) -> DataFrame:
    """(sheet_id, idx, box): disjoint boxes of each sheet, from the top left.

    Only cells that show something reach a kernel, and long runs of empty lines are cut
    first, so that arrays grow with the lines that have cells and not with how far apart
    they stand. Every sheet goes through all gaps, whatever its size; small sheets stand
    one below the other in one array, further apart than any gap.
    """
    x = cell_values(cells, attributes).where("value > 0").select("sheet_id", "r", "c", (F.col("content") > 0).alias("full"), (F.col("border") > 0).alias("marked"), "header_like")

    found = per_batch(x, ["r", "c", *MARKS], stacked_boxes, "sheet_id long, idx int, r0 int, c0 int, r1 int, c1 int")
    return found.select("sheet_id", "idx", F.struct("r0", "c0", "r1", "c1").alias("box"))
