"""Sheets as long tables of cells: (sheet_id, r, c, v), indices from 0, v the value's text or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = "sheet_id long, r int, c int, v string"
#: Columns of an order sheet, as text of whole numbers, codes and days.
ORDER_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Places of a gap that are listed together.
_STEP = 65536
EVENT_START = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_matrix(spark: SparkSession, rows: list[list], sheet_id: int = 0) -> DataFrame:
    """Cells of a list of rows; short rows are padded with nulls. Values become their text (True as True)."""
    width = max(map(len, rows), default=0)
    return spark.createDataFrame([(sheet_id, r, c, None if c >= len(row) or row[c] is None else str(row[c])) for r, row in enumerate(rows) for c in range(width)], CELLS)


def packed(table: DataFrame, sheet: Column, order: list[Column], columns: list[Column]) -> DataFrame:
    """Rows of a table's groups with their cells in a list: (sheet_id, r, v), a sheet for each value of ``sheet``, rows in ``order``, ``columns`` texts."""
    rows = table.withColumn("_sheet", sheet)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_sheet").orderBy(*order)) - 1)
    return rows.select(F.col("_sheet").alias("sheet_id"), F.col("_r").cast("int").alias("r"), F.array(*columns).alias("v"))


def unpivot(table: DataFrame, sheet: Column, order: list[Column], columns: list[Column]) -> DataFrame:
    """Cells of a table's groups: a sheet for each value of ``sheet``, rows in ``order``, one cell for each of ``columns`` (texts)."""
    return packed(table, sheet, order, columns).select("sheet_id", "r", F.posexplode("v").alias("c", "v"))


def order_texts() -> list[Column]:
    """The cells of an order's line."""
    whole = lambda c, n: F.round(F.col(c) * n).cast("bigint").cast("string")
    texts = {c: F.col(c).cast("string") for c in ORDER_COLUMNS} | {"l_quantity": whole("l_quantity", 1), "l_extendedprice": whole("l_extendedprice", 100), "l_discount": whole("l_discount", 100), "l_tax": whole("l_tax", 100)}
    texts["l_shipdate"] = F.date_format("l_shipdate", "yyyy-MM-dd")
    return [texts[c] for c in ORDER_COLUMNS]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet_id, r, v): a sheet for each order, a row for each of its lines with its cells in a list.

    Lines are dealt by order before they become ten cells each, so what groups cells of
    a sheet needs no other exchange; a sheet's rows stand together.
    """
    return packed(read(spark, sf_dir, "lineitem").repartition("l_orderkey"), F.col("l_orderkey"), [F.col(c) for c in ORDER_COLUMNS], order_texts())


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``order_rows``."""
    return order_rows(spark, sf_dir).select("sheet_id", "r", F.posexplode("v").alias("c", "v"))


def event_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each user: rows are hours since the first one with an event, columns event types by name, values counts.

    Only cells with events are rows of the result; all others are empty. Events are dealt
    by user once, so what groups cells of a sheet needs no other exchange.
    """
    events = read(spark, sf_dir, "events").select("user_id", "event_type", F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(EVENT_START).cast("timestamp"))) / 3600).alias("hour"))
    counts = events.repartition("user_id").groupBy("user_id", "event_type", "hour").agg(F.count("*").alias("n"))
    types = events.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("c"))
    first = F.min("hour").over(Window.partitionBy("user_id"))
    return counts.join(types, "event_type").select(F.col("user_id").alias("sheet_id"), (F.col("hour") - first).cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("n").cast("string").alias("v"))


def document_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each document: rows are lines, columns words between spaces."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet_id"), F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return lines.select("sheet_id", "r", F.posexplode(F.split("line", " ")).alias("c", "v"))


def shapes(cells: DataFrame) -> DataFrame:
    """(sheet_id, n_rows, n_cols) of each sheet, up to its last cell."""
    return cells.groupBy("sheet_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


def dense(cells: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Every place of each sheet's grid with its columns, null where there is no cell.

    The places between a cell and the one before it are made beside the cell, so cells
    are dealt by sheet and the grid isn't.
    """
    sizes = shapes(cells) if sizes is None else sizes
    rest = [n for n in cells.columns if n not in ("sheet_id", "r", "c")]
    x = cells.join(sizes.select("sheet_id", "n_rows", "n_cols"), "sheet_id").where("r between 0 and n_rows - 1 and c between 0 and n_cols - 1")
    x = x.select("sheet_id", "n_rows", "n_cols", (F.col("r").cast("long") * F.col("n_cols") + F.col("c")).alias("_at"), F.lit(False).alias("_end"), F.struct(*rest).alias("_cell"))
    ends = sizes.select("sheet_id", "n_rows", "n_cols", (F.col("n_rows").cast("long") * F.col("n_cols")).alias("_at"), F.lit(True).alias("_end"), F.lit(None).cast(x.schema["_cell"].dataType).alias("_cell"))
    x = x.unionByName(ends).withColumn("_from", F.coalesce(F.lag("_at").over(Window.partitionBy("sheet_id").orderBy("_at", "_end")), F.lit(-1)) + 1)
    x = x.withColumn("_from", F.when(F.col("_end"), F.col("_from")).otherwise(F.least("_from", "_at"))).withColumn("_to", F.when(F.col("_end"), F.col("_at") - 1).otherwise(F.col("_at"))).where("_from <= _to")
    x = x.withColumn("_from", F.explode(F.sequence("_from", "_to", F.lit(_STEP))))  # a long gap is never one list
    x = x.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_to"), F.col("_from") + (_STEP - 1)))))
    own = (F.col("_k") == F.col("_at")) & ~F.col("_end")
    place = [F.expr("cast(_k div n_cols as int)").alias("r"), (F.col("_k") % F.col("n_cols")).cast("int").alias("c")]
    return x.select("sheet_id", *place, "n_rows", "n_cols", *[F.when(own, F.col("_cell")[n]).alias(n) for n in rest])
