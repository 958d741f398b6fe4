"""Merged areas (sheet_id, r0, c0, r1, c1): cell to anchor, values, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_map(areas: DataFrame) -> DataFrame:
    """(sheet_id, r, c, ar, ac): every cell of an area and its anchor, the area's first cell."""
    rows = areas.select("sheet_id", F.col("r0").alias("ar"), F.col("c0").alias("ac"), "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    return rows.select("sheet_id", "r", F.explode(F.sequence("ac", "c1")).alias("c"), "ar", "ac")


def with_anchor_values(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Cells whose covered places take their anchor's value; places without a cell are added."""
    anchors = merged.join(cells.select("sheet_id", F.col("r").alias("ar"), F.col("c").alias("ac"), F.col("v").alias("_v")), ["sheet_id", "ar", "ac"], "left")
    covered = anchors.select("sheet_id", "r", "c", F.col("_v").alias("v"))
    return cells.join(merged, ["sheet_id", "r", "c"], "left_anti").select("sheet_id", "r", "c", "v").unionByName(covered)


def shown(cells: DataFrame) -> DataFrame:
    """(sheet_id, r, c, v): cells with the anchor (ar, ac) of the area they are in, else null; covered ones take their anchor's value.

    Only covered cells are sorted, each area within its sheet; the others pass. A sheet's
    cells stay where they are.
    """
    anchor = F.when((F.col("r") == F.col("ar")) & (F.col("c") == F.col("ac")), F.col("v"))
    covered = cells.where("ar is not null").select("sheet_id", "r", "c", F.max(anchor).over(Window.partitionBy("sheet_id", "ar", "ac")).alias("v"))
    return cells.where("ar is null").select("sheet_id", "r", "c", "v").unionByName(covered)


def spans(merged: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """(sheet_id, r, c, row_span, col_span) at each anchor; at its compressed place where maps are given, if kept."""
    out = merged.groupBy("sheet_id", F.col("ar").alias("r"), F.col("ac").alias("c")).agg((F.max("r") - F.min("r") + 1).alias("row_span"), (F.max("c") - F.min("c") + 1).alias("col_span"))
    for axis, map_ in (("r", rows), ("c", columns)):
        if map_ is not None:
            out = out.join(map_.select("sheet_id", F.col("oi").alias(axis), F.col("ci").alias("_n")), ["sheet_id", axis]).drop(axis).withColumnRenamed("_n", axis)
    return out.select("sheet_id", "r", "c", "row_span", "col_span")


def without_errors(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Cells whose kind is error, empty or blank lose their value, but for covered cells of merged areas."""
    bad = F.col("kind").isin("error", "empty", "blank")
    if merged is not None:
        covered = merged.where("r <> ar or c <> ac").select("sheet_id", "r", "c", F.lit(True).alias("_covered"))
        cells = cells.join(covered, ["sheet_id", "r", "c"], "left")
        return cells.withColumn("v", F.when(bad & F.col("_covered").isNull(), F.lit(None)).otherwise(F.col("v"))).drop("_covered")
    return cells.withColumn("v", F.when(bad, F.lit(None)).otherwise(F.col("v")))
