"""Features and compression maps kept between runs, found again by a sheet's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that sheets are spread over: a bounded number, whatever the number of sheets.
BUCKETS = 256
MAPPING = "original_shape array<int>, row_mapping map<string,int>, col_mapping map<string,int>"


def _bucket(key: str = "key"):
    return F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(BUCKETS)).cast("int")


def write_features(rows: DataFrame, path: str) -> None:
    """Adds rows (key, ...) as Parquet in folders by bucket, each written by one task at a time."""
    rows.withColumn("bucket", _bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_features(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Cached rows of ``keys`` (key); folders that none of them is in aren't read."""
    wanted = keys.select("key").distinct().withColumn("bucket", _bucket())
    return spark.read.parquet(path).join(wanted, ["bucket", "key"], "left_semi").drop("bucket")


def mapping_records(rows: DataFrame, columns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sheet_id, record): compressed to original indices and the original shape, in JSON."""
    as_map = lambda m, n: m.groupBy("sheet_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("ci"), F.col("oi"))))).alias(n))
    text_keys = lambda c: F.transform_keys(c, lambda k, _: k.cast("string")).alias(c)
    x = sizes.join(as_map(rows, "row_mapping"), "sheet_id", "left").join(as_map(columns, "col_mapping"), "sheet_id", "left")
    return x.select("sheet_id", F.to_json(F.struct(F.array("n_rows", "n_cols").alias("original_shape"), text_keys("row_mapping"), text_keys("col_mapping"))).alias("record"))


def read_mappings(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maps of rows and columns (sheet_id, ci, oi) and sizes (sheet_id, n_rows, n_cols) of ``mapping_records``."""
    x = records.select("sheet_id", F.from_json("record", MAPPING).alias("m"))
    axis = lambda n: x.select("sheet_id", F.explode(f"m.{n}").alias("k", "oi")).select("sheet_id", F.col("k").cast("int").alias("ci"), "oi")
    return axis("row_mapping"), axis("col_mapping"), x.select("sheet_id", F.get("m.original_shape", F.lit(0)).alias("n_rows"), F.get("m.original_shape", F.lit(1)).alias("n_cols"))
