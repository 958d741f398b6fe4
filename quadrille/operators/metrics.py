"""Scores of cell labels and of detected boxes, their roll-ups and curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_weights(labels: DataFrame, mode: str = "inverse", label: str = "y", classes: int = 5) -> DataFrame:
    """(label, n, weight): n rows / (classes * n), its square root, or 1; a class without rows counts as one."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    x = every.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    x = x.withColumn("_n", F.greatest("n", F.lit(1))).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    ratio = F.col("_all") / (classes * F.col("_n"))
    return x.select(label, "n", {"inverse": ratio, "sqrt": F.sqrt(ratio), "uniform": F.lit(1.0)}[mode].alias("weight"))


def file_class_weights(labels: DataFrame, file: str, label: str = "y") -> DataFrame:
    """(file, label, weight): rows of the file / (its classes * rows of the class)."""
    counts = labels.groupBy(file, label).agg(F.count("*").alias("n"))
    by = Window.partitionBy(file)
    return counts.select(file, label, (F.sum("n").over(by) / (F.count("*").over(by) * F.col("n"))).alias("weight"))


def confusion(scores: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return scores.groupBy(y, yhat).agg(F.count("*").alias("n"))


def accuracy(scores: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return scores.agg(F.avg((F.col(y) == F.col(yhat)).cast("int")).alias("accuracy"))


def _by_class(scores: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    """tp, fp, fn by keys and class: every row counts for its truth and its prediction."""
    sides = F.explode(F.array_distinct(F.array(F.struct(F.col(y).alias("class")), F.struct(F.col(yhat).alias("class"))))).alias("x")
    x = scores.select(*keys, F.col(y).alias("_y"), F.col(yhat).alias("_p"), sides).select(*keys, "_y", "_p", "x.class")
    total = lambda t: F.sum(t.cast("int"))
    own, hit = F.col("_y") == F.col("class"), F.col("_p") == F.col("class")
    return x.groupBy(*keys, "class").agg(total(own & hit).alias("tp"), total(~own & hit).alias("fp"), total(own & ~hit).alias("fn"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report(scores: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(class, precision, recall, f1, support), 0 where undefined."""
    x = _by_class(scores, [], y, yhat)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return x.select("class", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def file_class_f1(scores: DataFrame, file: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(file, class, f1) for classes that a file has in truth or prediction."""
    return _by_class(scores, [file], y, yhat).select(file, "class", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def file_macro_f1(scores: DataFrame, file: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(class, f1, files): each class's mean over the files that have it."""
    return file_class_f1(scores, file, y, yhat).groupBy("class").agg(F.avg("f1").alias("f1"), F.count("*").alias("files"))


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("f1").alias("macro_f1"))


def over_folds(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("folds"))


def make_folds(spark: SparkSession, n: int, folds: int = 5, seed: int = 2112) -> DataFrame:
    """(pos, fold): a seeded permutation of n rows cut into runs, the first n % folds of which are one longer.

    The permutation is numpy's legacy generator's, so that published splits come out again; n is a manifest's rows.
    """
    order = np.random.RandomState(seed).permutation(n)
    sizes = [n // folds + (f < n % folds) for f in range(folds)]
    fold = np.repeat(np.arange(folds), sizes)
    return spark.createDataFrame(pa.table({"pos": pa.array(order, pa.int32()), "fold": pa.array(fold, pa.int32())}), "pos int, fold int")


def table_scores(matches: DataFrame, counts: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.75, 0.95)) -> DataFrame:
    """Scores of each sheet at each threshold from matches (keys, iou) and counts (keys, n_pred, n_gt).

    mean_iou counts every unmatched box of either side as zero.
    """
    grouped = matches.groupBy(*keys).agg(F.count("*").alias("n_matched"), F.sum("iou").alias("_sum"), F.sort_array(F.collect_list("iou")).alias("_ious"))
    x = counts.join(grouped, keys, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0))).withColumn("_ious", F.coalesce("_ious", F.array().cast("array<double>")))
    boxes = F.col("n_pred") + F.col("n_gt") - F.col("n_matched")
    x = x.withColumn("mean_iou", _ratio(F.coalesce("_sum", F.lit(0.0)), boxes)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    x = x.withColumn("tp", F.size(F.filter("_ious", lambda v: v >= F.col("threshold"))))
    return with_ratios(x, "n_pred", "n_gt").select(*keys, "threshold", "n_pred", "n_gt", "n_matched", "mean_iou", "tp", "precision", "recall", "f1")


def with_ratios(x: DataFrame, n_pred: str, n_gt: str) -> DataFrame:
    """precision, recall and f1 of tp against the two counts."""
    tp = F.col("tp")
    x = x.withColumns({"precision": _ratio(tp, F.col(n_pred)), "recall": _ratio(tp, F.col(n_gt))})
    return x.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rolled_up(scores: DataFrame, by: list[str], truncated: bool = False) -> DataFrame:
    """Micro scores from summed counts, macro f1 from sheets, for each threshold and each prefix of ``by`` (and over all).

    truncated: true positives are taken again from precisions of four places and cut to
    whole numbers, as published totals were, which can lose one.
    """
    tp = F.floor(F.round("precision", 4) * F.col("n_pred")).cast("long") if truncated else F.col("tp").cast("long")
    x = scores.withColumn("_tp", tp).rollup("threshold", *by).agg(F.sum("_tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"), F.count("*").alias("sheets"), F.avg("f1").alias("macro_f1"), F.avg("mean_iou").alias("macro_iou"))
    return with_ratios(x.where("threshold is not null"), "n_pred", "n_gt")


def precision_curve(matches: DataFrame, counts: DataFrame, keys: list[str], fold: str, steps: int = 200, region: bool = False) -> DataFrame:
    """(fold, threshold, micro, macro): share of predictions matched at thresholds 0, 1/steps, ... 1.

    region: a sheet's predictions count up to its number of true boxes. Each match falls
    into the bucket of the last threshold it reaches; buckets are summed by fold, then
    from the highest down, so that a sheet costs its matches and not its thresholds.
    """
    cap = F.least("n_pred", "n_gt") if region else F.col("n_pred")
    capped = counts.select(*dict.fromkeys([*keys, fold]), cap.alias("_cap"))
    folds = capped.groupBy(fold).agg(F.sum("_cap").alias("_caps"), F.count("*").alias("_sheets"), F.sum(_ratio(F.col("_cap"), F.col("_cap"))).alias("_whole"))
    near = F.floor(F.col("iou") * steps)
    k = near + F.when(F.col("iou") >= (near + 1) / steps, 1).when(F.col("iou") < near / steps, -1).otherwise(0)
    x = matches.select(*keys, "iou").join(capped, keys).withColumn("k", k)
    x = x.groupBy(fold, "k").agg(F.count("*").alias("_hits"), F.sum(_ratio(F.lit(1), F.col("_cap"))).alias("_shares"))
    grid = folds.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    down = Window.partitionBy(fold).orderBy(F.desc("k"))
    x = grid.join(x, [fold, "k"], "left").withColumns({"_hits": F.sum(F.coalesce("_hits", F.lit(0))).over(down), "_shares": F.sum(F.coalesce("_shares", F.lit(0.0))).over(down)})
    first = F.col("k") == 0
    micro = _ratio(F.when(first, F.col("_caps")).otherwise(F.col("_hits")), F.col("_caps"))
    macro = F.when(first, F.col("_whole")).otherwise(F.col("_shares")) / F.col("_sheets")
    return x.select(fold, (F.col("k") / steps).alias("threshold"), micro.alias("micro"), macro.alias("macro"))


def curve_band(curve: DataFrame, value: str = "micro") -> DataFrame:
    return curve.groupBy("threshold").agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def common_keys(results: DataFrame, key: str, method: str, fold: str) -> DataFrame:
    """Keys that every method of a fold has."""
    per = results.groupBy(fold, key).agg(F.countDistinct(method).alias("n"))
    all_ = results.groupBy(fold).agg(F.countDistinct(method).alias("all"))
    return per.join(all_, fold).where(F.col("n") == F.col("all")).select(fold, key)


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't among finished results."""
    return todo.join(done.select(key), key, "left_anti")


def last_by_name(manifest: DataFrame, name: str, value: str, position: str) -> DataFrame:
    """One value for each name, that of its last row."""
    return manifest.groupBy(name).agg(F.max_by(value, position).alias(value))
