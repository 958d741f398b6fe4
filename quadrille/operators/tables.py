"""Tables in grids of cell labels: components, merging, coherence, headers, and duplicates.

The steps depend on each other's order within a sheet, so a sheet is one kernel's; what
it gets is its non-empty labels, what it gives its few tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .kernels import per_sheet, ranges, squeezed

EMPTY, HEADER, DATA, TITLE, OTHER = range(5)


@dataclass(frozen=True)
class Rules:
    """Thresholds. Gaps are in lines without content; shares are of a box's or a line's cells."""

    least_data: int = 4
    least_header: int = 8
    header_row: float = 0.4
    header_column: float = 0.4
    row_gap: int = 4
    column_gap: int = 2
    data_density: float = 0.05
    header_density: float = 0.5
    headerless_data: int = 20
    header_radius: int = 3
    same_iou: float = 0.5
    contained: float = 0.8
    sub_header: float = 0.5


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes is linked with by pairs (a, b), in whatever number of steps."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while not np.array_equal(further := least[least], least):
            least = further
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def component_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, end, number) of the runs of a mask's rows; numbers from 0 of their 4-connected components, by first run."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    at = np.flatnonzero(np.diff(wide, axis=1))
    start, end = at[::2], at[1::2]
    row = start // (w + 1)
    # runs of the row above that end after this one's start and start before its end
    low, high = np.searchsorted(end, start - (w + 1), "right"), np.searchsorted(start, end - (w + 1), "left")
    meets = np.maximum(high - low, 0)
    least = joined(len(row), np.repeat(np.arange(len(row)), meets), ranges(low, meets))
    number = np.cumsum(least == np.arange(len(row)))[least] - 1 if len(row) else least
    return row, start - row * (w + 1), end - row * (w + 1), number


def label_components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the 4-connected components of a mask, 0 elsewhere, by runs of each row that are joined all together."""
    h, w = mask.shape
    row, first, end, number = component_runs(mask)
    steps = np.zeros(h * (w + 1) + 1, np.int64)
    steps[row * (w + 1) + first] = number + 1
    steps[row * (w + 1) + end] = -number - 1
    return np.cumsum(steps[:-1]).reshape(h, w + 1)[:, :w]


def share(labels: np.ndarray, kind: int) -> float:
    """Share of a label among the cells that aren't empty."""
    full = int((labels != EMPTY).sum())
    return float((labels == kind).sum() / full) if full else 0.0


class Sheet:
    """One grid; boxes are [r0, c0, r1, c1], ends included."""

    def __init__(self, grid: np.ndarray, rules: Rules):
        self.g, self.rules = grid, rules

    def cut(self, r0, c0, r1, c1) -> np.ndarray:
        return self.g[max(0, r0) : r1 + 1, max(0, c0) : c1 + 1]

    def seeds(self) -> list[list[int]]:
        numbers = label_components((self.g == DATA) | (self.g == HEADER))
        rows, cols = np.nonzero(numbers)
        order = np.argsort(numbers[rows, cols], kind="stable")
        rows, cols = rows[order], cols[order]
        first = np.flatnonzero(np.diff(numbers[rows, cols], prepend=0))
        if not len(first):
            return []
        data = np.add.reduceat((self.g[rows, cols] == DATA).astype(np.int64), first)
        cells = np.diff(np.append(first, len(rows)))
        good = (data >= self.rules.least_data) | ((data == 0) & (cells >= self.rules.least_header))
        edges = np.stack([f.reduceat(x, first) for f, x in ((np.minimum, rows), (np.minimum, cols), (np.maximum, rows), (np.maximum, cols))], 1)
        return edges[good].tolist()

    def joins_down(self, a, b) -> bool | None:
        """Whether two boxes with common columns and rows between them are one table; None where that doesn't apply."""
        c0, c1 = max(a[1], b[1]), min(a[3], b[3])
        top, bottom = min(a[2], b[2]), max(a[0], b[0])
        if c0 > c1 or bottom <= top + 1:
            return None
        gap, wide = self.g[top + 1 : bottom, c0 : c1 + 1], c1 - c0 + 1
        if ((gap == HEADER).sum(1) / wide >= self.rules.header_row).any():
            return True
        apart = int(((gap == EMPTY) | (gap == TITLE)).all(1).sum())
        starts = (self.g[bottom, c0 : c1 + 1] == HEADER).sum() / wide >= self.rules.header_row
        return apart <= 1 if starts else apart < self.rules.row_gap

    def joins_across(self, a, b) -> bool:
        r0, r1 = max(a[0], b[0]), min(a[2], b[2])
        left, right = min(a[3], b[3]), max(a[1], b[1])
        if r0 > r1 or right <= left + 1:
            return False
        return int((self.g[r0 : r1 + 1, left + 1 : right] == EMPTY).all(0).sum()) < self.rules.column_gap

    def merged(self, boxes: list[list[int]]) -> list[list[int]]:
        """Rounds until nothing joins; in a round, a box joins the first one before it that it may, as they were at its start."""
        while True:
            into: dict[int, int] = {}
            for i in range(len(boxes)):
                for j in range(i + 1, len(boxes)):
                    if i in into:
                        break
                    if j not in into:
                        down = self.joins_down(boxes[i], boxes[j])
                        if down if down is not None else self.joins_across(boxes[i], boxes[j]):
                            into[j] = i
            if not into:
                return boxes
            boxes = [b.copy() for b in boxes]
            for j, i in sorted(into.items()):
                a, b = boxes[i], boxes[j]
                boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
            boxes = [b for k, b in enumerate(boxes) if k not in into]

    def coherent(self, b) -> bool:
        x = self.cut(*b)
        data, header = int((x == DATA).sum()), int((x == HEADER).sum())
        if not data:
            return header >= self.rules.least_header
        if data / x.size < self.rules.data_density and header / x.size < self.rules.header_density:
            return False
        if header or data >= self.rules.headerless_data:
            return True
        k = self.rules.header_radius
        return bool((self.cut(b[0] - k, b[1] - k, b[2] + k, b[3] + k) == HEADER).any())

    def table(self, b) -> dict:
        """A box grown over header lines above, left and right, with what they are."""
        r0, c0, r1, c1 = b
        top, left, right = r0, c0, c1
        while top and share(self.g[top - 1, c0 : c1 + 1], HEADER) >= self.rules.header_row:
            top -= 1
        while left and share(self.g[r0 : r1 + 1, left - 1], HEADER) >= self.rules.header_column:
            left -= 1
        while right + 1 < self.g.shape[1] and share(self.g[r0 : r1 + 1, right + 1], HEADER) >= self.rules.header_column:
            right += 1
        body = self.g[:, left : right + 1]
        subs = [r for r in range(r0 + 1, r1) if (body[r] == HEADER).mean() >= self.rules.sub_header and (body[r + 1 : r1 + 1] == DATA).any()]
        return {"r0": top, "c0": left, "r1": r1, "c1": right, "top_headers": list(range(top, r0)), "left_headers": list(range(left, c0)), "right_headers": list(range(c1 + 1, right + 1)), "sub_headers": subs, "fill": float((self.g[r0 : r1 + 1, c0 : c1 + 1] == DATA).mean())}

    def distinct(self, tables: list[dict]) -> list[dict]:
        """The largest first; one goes if it overlaps a kept one by the IoU, or lies in it by the share, of the rules."""
        size = lambda t: (t["r1"] - t["r0"] + 1) * (t["c1"] - t["c0"] + 1)
        kept: list[dict] = []
        for t in sorted(tables, key=size, reverse=True):
            for k in kept:
                both = max(0, min(t["r1"], k["r1"]) - max(t["r0"], k["r0"]) + 1) * max(0, min(t["c1"], k["c1"]) - max(t["c0"], k["c0"]) + 1)
                if both / (size(t) + size(k) - both) >= self.rules.same_iou or both / size(t) >= self.rules.contained:
                    break
            else:
                kept.append(t)
        return kept

    def tables(self) -> list[dict]:
        found = [self.table(b) for b in self.merged(self.seeds()) if self.coherent(b)]
        return self.distinct(found) if len(found) > 1 and self.rules.same_iou < 1 else found


_TABLES = "sheet_id long, idx int, r0 int, c0 int, r1 int, c1 int, top_headers array<int>, left_headers array<int>, right_headers array<int>, sub_headers array<int>, fill double"


def detect(labels: DataFrame, rules: Rules = Rules(), dealt: bool = False) -> DataFrame:
    """Tables of each sheet of labels (sheet_id, r, c, label), the order of ``idx`` being largest first."""

    names = [c.split()[0] for c in _TABLES.split(", ")][2:]

    def kernel(x: dict):
        full = x["label"] != EMPTY
        if not full.any():
            return
        x = {n: a[full] for n, a in x.items()}
        grid = np.zeros((x["r"].max() + 1, x["c"].max() + 1), np.int8)
        grid[x["r"], x["c"]] = x["label"]
        for i, t in enumerate(Sheet(grid, rules).tables()):
            yield (i, *(t[n] for n in names))

    return per_sheet(labels, ["r", "c", "label"], kernel, _TABLES, dealt)


def typed_regions(cells: DataFrame, dealt: bool = False) -> DataFrame:
    """(sheet_id, idx, type, r0, c0, r1, c1, n): 4-connected regions of one data type (cells with a null type are in none)."""

    def kernel(x: dict):
        known = np.array([t is not None for t in x["type"].tolist()])
        if not known.any():
            return
        x = {n: a[known] for n, a in x.items()}
        kinds, number = np.unique(x["type"].astype(str), return_inverse=True)
        (x_r, lines), (x_c, columns) = squeezed(x["r"], 1), squeezed(x["c"], 1)  # neighbours stay neighbours, and no others become so
        grid = np.full((len(lines), len(columns)), -1, np.int32)
        grid[x_r, x_c] = number
        rows = []
        for k, kind in enumerate(kinds):
            numbers = label_components(grid == k)
            at = np.flatnonzero(numbers)
            own = numbers.reshape(-1)[at]
            r, c = np.divmod(at, grid.shape[1])
            r, c = lines[r], columns[c]
            order = np.argsort(own, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                rows.append((int(r[some[0]]), int(c[some[0]]), str(kind), int(r[some].min()), int(c[some].min()), int(r[some].max()), int(c[some].max()), len(some)))
        rows.sort()
        for i, row in enumerate(rows):
            yield (i, *row[2:])

    schema = "sheet_id long, idx int, type string, r0 int, c0 int, r1 int, c1 int, n int"
    return per_sheet(cells, ["r", "c", "type"], kernel, schema, dealt)
