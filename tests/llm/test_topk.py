import numpy as np
from pyspark.sql import functions as F

from quadrille.llm import topk


def brute(rows, k=5):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def check(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0, **more).collect())) == brute(rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 20))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=20)).tolist()) for i in range(1200)]
    check(spark, rows)
    check(spark, rows, block=5)


def test_ties_nulls_repeats(spark):
    rows = [(i, [0.5, 0.25, 0.0]) for i in range(120)] + [(50, [0.5, 0.25, 0.0]), (50, [0.1, 0.1, 0.1]), (3, [0.5, 0.25, 0.0])]
    rows += [(200, None), (250, [None, 1.0, 1.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (401, [1.0, 3.0]), (450, []), (500, [30000.0, 1.0, 2.0]), (7, [-3e8, 5.0, 5.0])]
    check(spark, rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = np.floor(rng.normal(size=(50, 37)) * 100), np.floor(rng.normal(size=(60, 37)) * 100)
    for parts in topk.LEVELS:
        bound = np.concatenate(topk.segments(x, parts), 1) @ np.concatenate(topk.segments(y, parts), 1).T
        assert (bound >= x @ y.T - 1e-6).all()


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0
