"""Sheets encoded for a language model, its answers scored, and lines to train one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.style import UUID, base_name, file_uuid, result_id, stem
from ..functions.text import is_empty_for_features, token_estimate
from ..operators import boxes, compress, encode, metrics
from ..operators.kernels import per_sheet

PROMPT = "Below are the cells of a spreadsheet as (content|address) pairs. Name the ranges of its tables, headers and data but no titles or notes, like ['range': 'A1:F9']."
#: Texts longer than this many estimated tokens would be cut by the model.
MOST_TOKENS = 4096


def anchors(found: DataFrame, truth: DataFrame | None, axis: str) -> DataFrame:
    """(sheet_id, a): first and last lines of boxes (sheet_id, box); true boxes too where given, so that training keeps their corners."""
    both = found if truth is None else found.select("sheet_id", "box").unionByName(truth.select("sheet_id", "box"))
    return both.select("sheet_id", F.explode(F.array(f"box.{axis}0", f"box.{axis}1")).alias("a"))


def kept_axes(cells: DataFrame, found: DataFrame, truth: DataFrame | None = None, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Maps of rows and of columns near boxes, inner empty runs cut to their first and last line.

    A sheet's boxes and cells meet in one kernel, which counts lines by their intervals:
    a sheet without boxes keeps them all, and none is made that isn't kept.
    """
    full = (~is_empty_for_features(F.col("v"))).cast("int")
    near = [anchors(found, truth, axis).where("a is not null").select("sheet_id", *[(F.col("a") if n == axis else F.lit(-1)).alias(n) for n in "rc"], F.lit(2 if axis == "r" else 3).alias("kind")) for axis in "rc"]
    rows = cells.select("sheet_id", "r", "c", full.alias("kind")).unionByName(near[0]).unionByName(near[1])

    def kernel(x: dict):
        kind, lines, maps = x["kind"], {}, {}
        for axis, mark in (("r", 2), ("c", 3)):
            last, a = x[axis][kind < 2].max(initial=-1), x[axis][kind == mark]
            if len(a):
                ends = np.sort(np.stack([np.maximum(a - k, 0), np.minimum(a + k, last)], 1), 1)
                ends = ends[np.argsort(ends[:, 0], kind="stable")]
                reach = np.maximum.accumulate(ends[:, 1])
                new = np.flatnonzero(np.append(True, ends[1:, 0] > reach[:-1] + 1))
                start, end = ends[new, 0], reach[np.append(new[1:], len(ends)) - 1]
            else:
                start, end = np.array([0]), np.array([last])
            before = np.cumsum(end - start + 1) - (end - start + 1)
            own = x[axis][kind == 1]
            at = np.searchsorted(start, own, "right") - 1
            lines[axis] = (at >= 0) & (own <= end[at])
            maps[axis] = (start, before, before[at] + own - start[at])
        inside = lines["r"] & lines["c"]
        for axis, (start, before, own) in maps.items():
            i = np.unique(own[inside])
            wide = np.diff(i) > 2
            kept = np.sort(np.concatenate([i, i[:-1][wide] + 1, i[1:][wide] - 1]))
            at = np.searchsorted(before, kept, "right") - 1
            yield from ((axis, n, oi) for n, oi in enumerate((start[at] + kept - before[at]).tolist()))

    maps = per_sheet(rows, ["r", "c", "kind"], kernel, "sheet_id long, axis string, ci int, oi int")
    return tuple(maps.where(F.col("axis") == axis).select("sheet_id", "ci", "oi") for axis in "rc")


def encoded(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet_id, text, tokens) of the kept lines, as an inverted index."""
    x = encode.index_text(compress.compressed_cells(cells.select("sheet_id", "r", "c", "v"), rows, columns))
    return x.withColumn("tokens", token_estimate(F.col("text")))


def moved(ranges: DataFrame, rows: DataFrame, columns: DataFrame, to: str) -> DataFrame:
    """Ranges (sheet_id, idx, box) in the other space (``to``: original or compressed), by the nearest kept lines, corners in order."""
    key, value = ("ci", "oi") if to == "original" else ("oi", "ci")
    x = ranges
    for axis, map_ in (("r", rows), ("c", columns)):
        for end in "01":
            side = f"{axis}{end}"
            wanted = x.select("sheet_id", F.col(f"box.{side}").alias("x")).distinct()
            near = compress.nearest(map_, wanted, key, value).select("sheet_id", F.col("x").cast("int").alias("_x"), F.col(value).alias(f"_{side}"))
            x = x.withColumn("_x", F.col(f"box.{side}")).join(near, ["sheet_id", "_x"], "left").drop("_x").withColumn(f"_{side}", F.coalesce(f"_{side}", f"box.{side}"))
    moved_box = boxes.box(F.least("_r0", "_r1"), F.least("_c0", "_c1"), F.greatest("_r0", "_r1"), F.greatest("_c0", "_c1"))
    return x.withColumn("box", moved_box).drop("_r0", "_r1", "_c0", "_c1")


def answered(texts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = PROMPT, batch: int = 32) -> DataFrame:
    """(sheet_id, answer, seconds): any batch function from prompts to answers, on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                began = time.time()
                answers = model([f"{prompt}\nINPUT:\n{t}" for t in part["text"]])
                yield pd.DataFrame({"sheet_id": part["sheet_id"], "answer": answers, "seconds": (time.time() - began) / len(part)})

    return texts.select("sheet_id", "text").mapInPandas(run, "sheet_id long, answer string, seconds double")


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers with their ranges, whether quotes were mended, and whether none is a range."""
    found = A.found_ranges(F.col(column))
    return answers.withColumns({"ranges": found, "corners_merged": A.corners_merged(F.col(column)), "invalid": A.no_valid_range(found)})


def completion(ranges: Column) -> Column:
    """An array of ranges as a model should answer."""
    return F.concat(F.lit("["), F.array_join(F.transform(ranges, lambda r: F.concat(F.lit("'range': '"), r, F.lit("'"))), ", "), F.lit("]"))


def training_lines(texts: DataFrame, truth: DataFrame, rows: DataFrame, columns: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """(sheet_id, line, tokens, cut): chat lines in JSON; sheets without a true box have none."""
    inside = moved(truth.select("sheet_id", "idx", "box"), rows, columns, "compressed")
    answers = inside.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("idx", A.format_range(F.col("box"), False).alias("t")))).alias("x")).select("sheet_id", completion(F.col("x.t")).alias("answer"))
    said = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(prompt + "\nINPUT:\n"), F.col("text")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    x = texts.join(answers, "sheet_id")
    return x.select("sheet_id", F.to_json(F.struct(said.alias("messages"))).alias("line"), "tokens", (F.col("tokens") > MOST_TOKENS).alias("cut"))


def line_statistics(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean_tokens"), F.max("tokens").alias("most_tokens"), F.count_if("cut").alias("cut"))


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON lines in the order of sheets; an existing result stays."""
    lines.orderBy("sheet_id").select(F.col("line").alias("value")).write.mode("ignore").text(path)


def range_rows(records: DataFrame, column: str, key: str = "file_id", mode: str = "tolerant") -> DataFrame:
    """(key, fold, idx, box) of an array of ranges; those that can't be read are left out, the others numbered as they stand."""
    x = records.select(key, "fold", F.posexplode(column).alias("idx", "range"))
    return x.select(key, "fold", "idx", A.parse_range(F.col("range"), mode).alias("box")).where("box is not null and box.r0 >= 0")


def replayed(records: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75, 0.95)) -> DataFrame:
    """(file_id, fold, threshold, tp, fp, fn) of finished records, matched anew in input order; threshold 1 is exact."""
    x = records.withColumn("file_id", result_id(F.col("file_path"), F.col("sheet_name")))
    keys = ["file_id", "fold"]
    p, g = range_rows(x, "predicted_ranges"), range_rows(x, "gt_ranges")
    pairs = boxes.overlapping_pairs(p, g, keys)
    every = x.select(*keys, F.explode(F.array(*[F.lit(float(t)) for t in (*thresholds, 1.0)])).alias("threshold"))
    hits = None
    for t in (*thresholds, 1.0):
        part = boxes.first_fit(pairs, keys, t).groupBy(*keys).agg(F.count("*").alias("tp")).withColumn("threshold", F.lit(float(t)))
        hits = part if hits is None else hits.unionByName(part)
    n_p, n_g = (r.groupBy(*keys).agg(F.count("*").alias(n)) for r, n in ((p, "np"), (g, "ng")))
    out = every.join(hits, [*keys, "threshold"], "left").join(n_p, keys, "left").join(n_g, keys, "left").na.fill(0, ["tp", "np", "ng"])
    return out.select(*keys, "threshold", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def micro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores from summed tp, fp and fn for each threshold, and each value of ``by`` and over all."""
    x = scores.rollup("threshold", *(by or [])).agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")], F.count("*").alias("sheets")).where("threshold is not null")
    return metrics.with_ratios(x.withColumns({"n_pred": F.col("tp") + F.col("fp"), "n_gt": F.col("tp") + F.col("fn")}), "n_pred", "n_gt")


def converted(records: DataFrame) -> DataFrame:
    """(fold, file, predicted_ranges, gt_ranges, n_predicted, n_gt) without failed records and repeated predictions; folds as fold_01."""
    p, g = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("predicted_ranges", "gt_ranges"))
    once = F.array_distinct(p)
    return records.where("error is null").select(F.concat(F.lit("fold_"), F.lpad((F.col("fold") + 1).cast("string"), 2, "0")).alias("fold"), F.col("file_path").alias("file"), once.alias("predicted_ranges"), g.alias("gt_ranges"), F.size(once).alias("n_predicted"), F.size(g).alias("n_gt"))


def _present(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything that a reader would see."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(p))


def write_results(results: DataFrame, path: str, done: DataFrame | None = None, key: str = "file_id") -> None:
    """Results by fold as JSON. What is there stays: rows whose key is in the folder, or in ``done``, are left out, so that a rerun adds nothing."""
    spark = results.sparkSession
    if done is None and _present(spark, path):
        done = spark.read.schema(results.schema).json(path)
    todo = results if done is None else metrics.unfinished(results, done, key)
    todo.write.mode("append").partitionBy("fold").json(path)


def write_grids(predicted: DataFrame, expected: DataFrame, path: str) -> DataFrame:
    """Predicted labels (fold, uuid, r, c, label) as Parquet by fold, those of sheets that the folder doesn't hold.

    Returns (uuid, status): ok, or shape_mismatch against (uuid, n_rows, n_cols), of what the folder holds afterwards.
    """
    spark = predicted.sparkSession
    schema = predicted.schema
    todo = predicted.join(spark.read.schema(schema).parquet(path).select("uuid").distinct(), "uuid", "left_anti").select(*predicted.columns) if _present(spark, path) else predicted
    todo.write.mode("append").partitionBy("fold").parquet(path)
    seen = spark.read.schema(schema).parquet(path).groupBy("uuid").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.count("*").alias("n"))
    good = (F.col("h") == F.col("n_rows")) & (F.col("w") == F.col("n_cols")) & (F.col("n") == F.col("n_rows") * F.col("n_cols"))
    return expected.join(seen, "uuid", "left").select("uuid", F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("shape_mismatch").alias("status"))


def stale(cached: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose cached shape (key, n_rows, n_cols) isn't the expected one, or that aren't cached."""
    return expected.join(cached, [key, "n_rows", "n_cols"], "left_anti").select(key)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    from ..sources.files import results

    return results(spark, path)


def canonical_keys(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records`` (labels_path, file_path) with key: a UUID in the annotation's path, else in the file's name, else the manifest's for the name, or its stem, in any case.

    manifest: (file_path, uuid, position); the last of several rows of a name counts.
    """
    low = lambda c: F.lower(c)
    names = manifest.select(low(base_name(F.col("file_path"))).alias("name"), low(stem(F.col("file_path"))).alias("stem"), "uuid", "position")
    by_name = metrics.last_by_name(names, "name", "uuid", "position").select(F.col("name").alias("_name"), F.col("uuid").alias("_u1"))
    by_stem = metrics.last_by_name(names, "stem", "uuid", "position").select(F.col("stem").alias("_stem"), F.col("uuid").alias("_u2"))
    own = F.when(stem(F.col("file_path")).rlike(f"^{UUID}$"), stem(F.col("file_path")))
    x = records.withColumns({"_k": F.coalesce(file_uuid(F.col("labels_path")), own), "_name": low(base_name(F.col("file_path"))), "_stem": low(stem(F.col("file_path")))})
    x = x.join(by_name, "_name", "left").join(by_stem, "_stem", "left")
    return x.withColumn("key", F.coalesce("_k", "_u1", "_u2")).select(*records.columns, "key")


def resolved_styles(styles: DataFrame) -> DataFrame:
    """(name, property, value): properties of styles (name, parent, property, value) with what they inherit, the nearest ancestor's first.

    Chains are followed to their end however long, and end where a name would repeat.
    Each way to an ancestor counts where a name has several parents.
    """
    deepest = styles.select("name").distinct().count() + 1
    return styles.sparkSession.sql(
        f"""
        WITH RECURSIVE chain (name, ancestor, way) MAX RECURSION LEVEL {deepest} AS (
            SELECT DISTINCT name, name, array(name) FROM {{styles}}
            UNION ALL SELECT c.name, p.parent, array_append(c.way, p.parent)
            FROM chain c JOIN (SELECT DISTINCT name, parent FROM {{styles}} WHERE parent IS NOT NULL) p ON p.name = c.ancestor WHERE NOT array_contains(c.way, p.parent))
        SELECT c.name, s.property, min_by(s.value, size(c.way)) AS value FROM chain c JOIN {{styles}} s ON s.name = c.ancestor WHERE s.property IS NOT NULL GROUP BY c.name, s.property""",
        styles=styles,
    )
