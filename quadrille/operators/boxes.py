"""Boxes (r0, c0, r1, c1), ends included: measures, overlaps, and one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDES = ("r0", "c0", "r1", "c1")


def box(r0, c0, r1, c1) -> Column:
    part = lambda x, n: (x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n)
    return F.struct(part(r0, "r0"), part(c0, "c0"), part(r1, "r1"), part(c1, "c1"))


def area(b: Column) -> Column:
    return (b["r1"] - b["r0"] + 1) * (b["c1"] - b["c0"] + 1)


def overlap_area(a: Column, b: Column) -> Column:
    height = F.least(a["r1"], b["r1"]) - F.greatest(a["r0"], b["r0"]) + 1
    width = F.least(a["c1"], b["c1"]) - F.greatest(a["c0"], b["c0"]) + 1
    return F.greatest(F.lit(0), height) * F.greatest(F.lit(0), width)


def iou(a: Column, b: Column) -> Column:
    both = overlap_area(a, b)
    return F.when(both == 0, F.lit(0.0)).otherwise(both / (area(a) + area(b) - both))


def overlaps(a: Column, b: Column) -> Column:
    return overlap_area(a, b) > 0


def contains(outer: Column, inner: Column, step: int = 0) -> Column:
    """Whether ``inner`` lies in ``outer``, each side of which may be up to ``step`` further in."""
    return (outer["r0"] <= inner["r0"] + step) & (outer["c0"] <= inner["c0"] + step) & (outer["r1"] >= inner["r1"] - step) & (outer["c1"] >= inner["c1"] - step)


def nearly_same(a: Column, b: Column, step: int = 2, along: str = "both") -> Column:
    """Whether sides differ by at most ``step``: of rows, of columns, or of both."""
    close = lambda n: F.abs(a[n] - b[n]) <= step
    rows, columns = close("r0") & close("r1"), close("c0") & close("c1")
    return {"rows": rows, "columns": columns, "both": rows & columns}[along]


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["r0"], b["r0"]), F.least(a["c0"], b["c0"]), F.greatest(a["r1"], b["r1"]), F.greatest(a["c1"], b["c1"]))


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null."""
    return F.when(overlaps(a, b), box(F.greatest(a["r0"], b["r0"]), F.greatest(a["c0"], b["c0"]), F.least(a["r1"], b["r1"]), F.least(a["c1"], b["c1"])))


def edge_slice(b: Column, side: str, start: int = 0, step: int = 1) -> Column:
    """``step`` lines of a box from its top, bottom, left or right, after the first ``start``."""
    last = start + step - 1
    return {
        "top": lambda: box(b["r0"] + start, b["c0"], b["r0"] + last, b["c1"]),
        "bottom": lambda: box(b["r1"] - last, b["c0"], b["r1"] - start, b["c1"]),
        "left": lambda: box(b["r0"], b["c0"] + start, b["r1"], b["c0"] + last),
        "right": lambda: box(b["r0"], b["c1"] - last, b["r1"], b["c1"] - start),
    }[side]()


def overlapping_pairs(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pi, gi, iou) of pairs that share a cell; both sides have keys, idx and box.

    The join is on the keys, so it never leaves a sheet.
    """
    p = predicted.select(*keys, F.col("idx").alias("pi"), F.col("box").alias("p"))
    g = truth.select(*keys, F.col("idx").alias("gi"), F.col("box").alias("g"))
    return p.join(g, keys).where(overlaps(F.col("p"), F.col("g"))).select(*keys, "pi", "gi", iou(F.col("p"), F.col("g")).alias("iou"))


def _greedy(ordered: Column) -> Column:
    """Of pairs in order, those whose two sides are both still free."""
    empty = F.array().cast("array<struct<pi:int,gi:int,iou:double>>")

    def step(taken, x):
        free = ~F.exists(taken, lambda t: (t["pi"] == x["pi"]) | (t["gi"] == x["gi"]))
        return F.when(free, F.concat(taken, F.array(F.struct(x["pi"].cast("int").alias("pi"), x["gi"].cast("int").alias("gi"), x["iou"].cast("double").alias("iou"))))).otherwise(taken)

    return F.aggregate(ordered, empty, step)


def best_first(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches (keys, pi, gi, iou), the highest overlap first; ties by pi, then gi."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("down"), "pi", "gi", "iou")))
    return pairs.groupBy(*keys).agg(ordered.alias("x")).select(*keys, F.explode(_greedy(F.col("x"))).alias("m")).select(*keys, "m.pi", "m.gi", "m.iou")


def first_fit(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One-to-one matches in input order: each prediction takes the first free truth at ``threshold`` or more.

    A threshold of 1 is an exact match, as whole boxes alone overlap fully.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pi", "gi", "iou")))
    return pairs.where(F.col("iou") >= threshold).groupBy(*keys).agg(ordered.alias("x")).select(*keys, F.explode(_greedy(F.col("x"))).alias("m")).select(*keys, "m.pi", "m.gi", "m.iou")
