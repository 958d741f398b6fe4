"""Files of sheets, manifests, annotations and results as tables."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import parse_range
from ..functions.style import annotation_key, cache_key
from . import workbooks

MANIFEST = "source string, file_path string, sheet_name string, mime_type string, labels_path string, uuid string, url string"
RESULTS = (
    "file_path string, sheet_name string, labels_path string, n_rows int, n_cols int, k_anchor int, compressed_tokens int, gt_ranges array<string>, predicted_ranges array<string>, "
    "predicted_ranges_compressed array<string>, range_corners_merged boolean, no_valid_prediction boolean, llm_response string, llm_tokens int, llm_elapsed double, "
    "metrics struct<precision:double,recall:double,f1:double,tp:int,fp:int,fn:int,n_pred:int,n_gt:int>, metrics_iou map<string,double>, elapsed_sec double, error string"
)
_CELLS = pa.schema([("file_path", pa.string()), ("sheet", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.string()), ("kind", pa.string()), ("nf", pa.string()), ("attrs", pa.list_(pa.string())), ("style", pa.int32()), ("r1", pa.int32()), ("c1", pa.int32()), ("error", pa.string())])
CELLS = "file_path string, sheet string, r int, c int, v string, kind string, nf string, attrs array<string>, style int, r1 int, c1 int, error string"


def manifest(spark: SparkSession, path: str, excluded: str | None = None) -> DataFrame:
    """Rows of a manifest in csv; files whose name holds ``excluded`` are left out. key names a sheet in caches."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST)
    if excluded:
        rows = rows.where(~F.contains(F.col("file_path"), F.lit(excluded)))
    return rows.withColumn("key", cache_key(F.col("file_path"), F.col("sheet_name"))).withColumn("sheet_file", annotation_key(F.col("labels_path")))


def sheets(spark: SparkSession, paths: str | list[str], names: DataFrame | None = None, profile: str = "classifier", batch: int = 8192) -> DataFrame:
    """Cells of files (``CELLS``), one task reading one file at a time from Spark's own reader.

    names: (file_path, sheet_name, mime_type) for files that hold more than their first
    sheet. Merged areas are rows of kind merge, from (r, c) to (r1, c1). A file that can't
    be read gives one row of kind failed, with the error.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), "content")
    if names is not None:
        files = files.join(names.select(F.col("file_path").alias("path"), "sheet_name", "mime_type"), "path", "left")
    else:
        files = files.withColumns({"sheet_name": F.lit(None).cast("string"), "mime_type": F.lit(None).cast("string")})

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, data, name, mime = (b.column(k)[i].as_py() for k in range(4))
                try:
                    s = workbooks.read(path, data, name, mime, profile)
                    rows = [(path, s.name, r, c, x.v, x.kind, x.nf, x.attrs, x.style, None, None, None) for (r, c), x in sorted(s.cells.items())]
                    rows += [(path, s.name, r0, c0, None, "merge", None, None, None, r1, c1, None) for r0, c0, r1, c1 in s.merges]
                except Exception as e:  # a broken file is a row, not the end of the job
                    rows = [(path, name, None, None, None, "failed", None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                for at in range(0, len(rows), batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + batch]), _CELLS)], schema=_CELLS)

    return files.select("path", "content", "sheet_name", "mime_type").mapInArrow(run, CELLS)


def formats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, format): by content, then extension; zips are told apart by their members."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        for b in batches:
            kinds = []
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    kinds.append(workbooks.detect_format(p, d))
                except ValueError:
                    kinds.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], ["file_path", "format"])

    return files.mapInArrow(run, "file_path string, format string")


#: A style as its file says it; colours are texts, theme numbers with tints, or indices, with the workbook's own palette.
STYLES = (
    "file_path string, sheet string, style int, bold boolean, italic boolean, underline boolean, size double, font string, fg_argb string, fg_theme int, fg_tint double, fg_indexed int, fg_index int, fg_palette array<int>, "
    "bg_argb string, bg_theme int, bg_tint double, bg_indexed int, bg_index int, bg_palette array<int>, border_left boolean, border_right boolean, border_top boolean, border_bottom boolean, h_align int, v_align int"
)


def styles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The styles of each workbook's first sheet (``STYLES``), a row for each that its cells may refer to; other files have none."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = [c.strip().split(" ")[0] for c in STYLES.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    s = workbooks.read(path, data, profile="encoder")
                except Exception:  # ``sheets`` has a row for it
                    continue
                rows += [{"file_path": path, "sheet": s.name, "style": i} | x for i, x in enumerate(s.styles)]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.mapInPandas(run, STYLES)


def split_cells(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (sheet_id, r, c, v, kind, nf, attrs, style), merged areas (sheet_id, r0, c0, r1, c1) and failures (file_path, error) of ``sheets``."""
    x = read.withColumn("sheet_id", F.xxhash64("file_path", "sheet"))
    cells = x.where("kind not in ('merge', 'failed')").select("sheet_id", "r", "c", "v", "kind", "nf", "attrs", "style")
    areas = x.where("kind = 'merge'").select("sheet_id", F.col("r").alias("r0"), F.col("c").alias("c0"), "r1", "c1")
    return cells, areas, read.where("kind = 'failed'").select("file_path", "error")


def ground_truth(spark: SparkSession, paths: str | list[str], original: bool = True) -> DataFrame:
    """(file_path, idx, range, box) from annotations in npz: ``ranges_original`` where asked for and there, else ``ranges``."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import numpy as np

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    key = "ranges_original" if original and "ranges_original" in z else "ranges"
                    found = [x.decode() if isinstance(x, bytes) else str(x) for x in z[key].reshape(-1)] if key in z else []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["file_path", "idx", "range"])

    return files.mapInArrow(run, "file_path string, idx int, range string").withColumn("box", parse_range(F.col("range"), "pair"))


def label_grids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, r, c, label) from annotations in npz, moved by their anchor."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import numpy as np

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    grid = z["labels"]
                    dr, dc = (int(x) for x in z["anchor_labels"]) if "anchor_labels" in z else (0, 0)
                r, c = np.indices(grid.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * grid.size, pa.string()), pa.array((r + dr).astype(np.int32)), pa.array((c + dc).astype(np.int32)), pa.array(grid.reshape(-1).astype(np.int32))], ["file_path", "r", "c", "label"])

    return files.mapInArrow(run, "file_path string, r int, c int, label int")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Records of finished sheets in JSON, one a file; timing files, which have no metrics, are left out. fold comes from the folder."""
    rows = spark.read.schema(RESULTS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("fold", F.regexp_extract(F.input_file_name(), r"fold_(\d+)", 1).try_cast("int")).where("metrics is not null")


def per_file_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, predicted_ranges, gt_ranges) of metrics.json files."""
    schema = "per_file array<struct<file:string,predicted_ranges:array<string>,gt_ranges:array<string>,n_predicted:int,n_gt:int>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("from"), F.inline("per_file"))

