"""Cross-validated classification of cells: features, a forest, and a grid model over its probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty_for_compression
from ..operators import features, metrics, models
from ..operators.compress import collapsed, compressed_cells, filled

#: Sheets with more cells take no part in training.
MOST_CELLS = 2500


@dataclass(frozen=True)
class Job:
    """What to train: a forest by name, its size, and whether a grid model follows on its probabilities."""

    forest: str = "all"
    trees: int | None = None
    depth: int | None = None
    grid: bool = False
    rounds: int = 10
    weights: str = "inverse"
    most_cells: int = MOST_CELLS


def prepared(cells: DataFrame, labels: DataFrame, formats: DataFrame | None = None, merges: DataFrame | None = None, file_format: str = "csv", date=None) -> DataFrame:
    """Features of each place of the compressed sheets with their label y (empty places without a label are EMPTY); labels are in compressed space."""
    empty = is_empty_for_compression(F.col("v"))
    rows, columns = collapsed(filled(cells, "r", empty)), collapsed(filled(cells, "c", empty))
    x = features.unary(compressed_cells(cells.select("sheet_id", "r", "c", "v"), rows, columns), file_format, merges, formats, date)
    return x.join(labels.select("sheet_id", "r", "c", F.col("label").cast("int").alias("y")), ["sheet_id", "r", "c"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def small_enough(rows: DataFrame, most: int) -> DataFrame:
    sizes = rows.groupBy("sheet_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("sheet_id")
    return rows.join(sizes, "sheet_id", "left_semi")


def nodes_of(scored: DataFrame) -> DataFrame:
    """Cells of a grid model: probabilities and a constant as features."""
    return scored.select("sheet_id", "r", "c", F.concat("p", F.array(F.lit(1.0))).alias("x"), "y", (F.col("is_na") > 0.5).alias("is_empty"))


def edges_of(rows: DataFrame) -> DataFrame:
    pairs = features.pairwise(rows)
    return pairs.select("sheet_id", "r", "c", "r2", "c2", F.array(*features.PAIR).alias("f"))


def cross_validated(rows: DataFrame, folds: DataFrame, job: Job = Job(), states: int = len(models.STATES)) -> DataFrame:
    """(fold, sheet_id, r, c, y, yhat) of every sheet, predicted by models of the other folds; folds: (sheet_id, fold).

    One model for each fold, whose number is fixed; the rest is joins and one pass of
    each model. Every class must occur in every training part.
    """
    rows = rows.join(folds, "sheet_id")
    edges = edges_of(rows) if job.grid else None
    out = None
    for fold in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        train, held = small_enough(rows.where(F.col("fold") != fold), job.most_cells), rows.where(F.col("fold") == fold)
        fitted = models.forest(job.forest, job.trees, job.depth).fit(models.with_weights(train))
        scored = models.probabilities(fitted.transform(held), states)
        if not job.grid:
            part = scored.select("fold", "sheet_id", "r", "c", "y", F.col("prediction").cast("int").alias("yhat"))
        else:
            seen = models.probabilities(fitted.transform(train), states)
            cost = {r["y"]: r["weight"] for r in metrics.class_weights(train, job.weights, classes=states).collect()}
            model = models.GridModel(states + 1, len(features.PAIR), states)
            model, _ = models.grid_fit(nodes_of(seen), edges.join(train.select("sheet_id").distinct(), "sheet_id", "left_semi"), model, cost, job.rounds)
            guess = models.grid_predict(nodes_of(scored), edges.join(held.select("sheet_id").distinct(), "sheet_id", "left_semi"), model)
            part = held.select("fold", "sheet_id", "r", "c", "y").join(guess, ["sheet_id", "r", "c"]).select("fold", "sheet_id", "r", "c", "y", "yhat")
        out = part if out is None else out.unionByName(part)
    return out


def summary(scored: DataFrame) -> DataFrame:
    """(metric, mean, std, folds): accuracy and file-macro F1 over folds."""
    accuracy = scored.groupBy("fold").agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("value")).withColumn("metric", F.lit("accuracy"))
    per_file = metrics._by_class(scored, ["fold", "sheet_id"], "y", "yhat").select("fold", "class", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))
    f1 = per_file.groupBy("fold", "class").agg(F.avg("f1").alias("f1")).groupBy("fold").agg(F.avg("f1").alias("value")).withColumn("metric", F.lit("file_macro_f1"))
    return metrics.over_folds(accuracy.unionByName(f1), ["metric"], "value")
