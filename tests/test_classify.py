from pyspark.sql import functions as F

from quadrille.plans import classify
from quadrille.sources import cells as C


def test_cross_validation(spark):
    rows = [(s, r, c, None if (r * 3 + c + s) % 7 == 0 and r else (f"head{c}" if r == 0 else str(r * c + s))) for s in range(9) for r in range(5) for c in range(4)]
    cells = spark.createDataFrame(rows, C.CELLS)
    labels = cells.select("sheet_id", "r", "c", F.when(F.col("v").isNull(), 0).when(F.col("r") == 0, 1).otherwise(2).alias("label"))
    x = classify.prepared(cells, labels, date=F.lit(False)).cache()
    assert x.count() == 9 * 20
    folds = spark.createDataFrame([(s, s % 3) for s in range(9)], "sheet_id long, fold int")
    for grid in (False, True):
        scored = classify.cross_validated(x, folds, classify.Job("selected", 6, 5, grid, 4), states=3).cache()
        assert scored.count() == 9 * 20
        got = {r.metric: r for r in classify.summary(scored).collect()}
        assert got["accuracy"].folds == 3 and got["accuracy"].mean > 0.9 and got["file_macro_f1"].mean > 0.85
    assert classify.small_enough(x, 19).count() == 0
