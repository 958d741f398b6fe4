import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions.text import is_empty_for_compression
from quadrille.operators import boxes, compress, encode, features, merges, metrics, tables
from quadrille.sources import cells as C


def brute_collapse(full, n, keep=2, tail=0):
    out, run = [], 0
    last = max((i for i in range(n) if full[i]), default=-1)
    for i in range(n):
        run = 0 if full[i] else run + 1
        limit = keep if i < last else tail
        if full[i] or run <= limit:
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_compression(spark, seed):
    rng = random.Random(seed)
    sheets = {s: [rng.random() < 0.35 for _ in range(rng.randint(1, 60))] for s in range(12)}
    sheets = {s: f for s, f in sheets.items() if any(f)}
    rows = [(s, i, 0, "x" if f else rng.choice([None, " ", "None"])) for s, full in sheets.items() for i, f in enumerate(full)]
    frame = spark.createDataFrame(rows, C.CELLS)
    lines = compress.filled(frame, "r", is_empty_for_compression(F.col("v")))
    sizes = spark.createDataFrame([(s, len(f)) for s, f in sheets.items()], "sheet_id long, n_rows int")

    def of(map_):
        out = {}
        for r in map_.orderBy("sheet_id", "ci").collect():
            assert len(out.setdefault(r.sheet_id, [])) == r.ci
            out[r.sheet_id].append(r.oi)
        return out

    assert of(compress.collapsed(lines)) == {s: brute_collapse(f, len(f)) for s, f in sheets.items()}
    assert of(compress.collapsed(lines, 2, sizes)) == {s: brute_collapse(f, len(f), 2, 2) for s, f in sheets.items()}
    want = {}
    for s, f in sheets.items():
        runs, i = [], 0
        while i < len(f):
            j = i
            while j < len(f) and f[j] == f[i]:
                j += 1
            runs.append((i, j, f[i]))
            i = j
        want[s] = [k for a, b, x in runs for k in range(a, b) if x or (b - a >= 2 and a > 0 and b < len(f) and k in (a, b - 1))]
    assert of(compress.spaces_deleted(lines)) == want
    back = compress.expanded(compress.compressed_cells(frame.where("v = 'x'"), compress.collapsed(lines), compress.reindexed(spark.createDataFrame([(s, 0) for s in sheets], "sheet_id long, i int"))).withColumn("label", F.lit(1)), compress.collapsed(lines), compress.reindexed(spark.createDataFrame([(s, 0) for s in sheets], "sheet_id long, i int")), sizes.withColumn("n_cols", F.lit(1)))
    assert {(r.sheet_id, r.r) for r in back.where("label = 1").collect()} == {(s, i) for s, f in sheets.items() for i, x in enumerate(f) if x}


def test_cut_off_and_anchors(spark):
    lines = spark.createDataFrame([(1, i) for i in (0, 5, 206, 207)] + [(2, 300)], "sheet_id long, i int")
    assert sorted((r.sheet_id, r.i) for r in compress.cut_off(lines).collect()) == [(1, 0), (1, 5)]
    sizes = spark.createDataFrame([(1, 20), (2, 3)], "sheet_id long, n_rows int")
    near = compress.near_anchors(spark.createDataFrame([(1, 1), (1, 18)], "sheet_id long, a int"), sizes, "n_rows", 2)
    assert sorted((r.sheet_id, r.i) for r in near.collect()) == [(1, i) for i in (0, 1, 2, 3, 16, 17, 18, 19)] + [(2, 0), (2, 1), (2, 2)]


def test_merges(spark):
    areas = spark.createDataFrame([(1, 0, 0, 1, 2)], "sheet_id long, r0 int, c0 int, r1 int, c1 int")
    map_ = merges.merge_map(areas)
    assert map_.count() == 6
    grid = C.from_matrix(spark, [["a", None, None, "d"], [None, "x", None, "e"]], 1)
    got = {(r.r, r.c): r.v for r in merges.with_anchor_values(grid, map_).collect()}
    assert got == {(r, c): "a" for r in range(2) for c in range(3)} | {(0, 3): "d", (1, 3): "e"}
    assert [tuple(r) for r in merges.spans(map_).collect()] == [(1, 0, 0, 2, 3)]
    kinds = grid.withColumn("kind", F.when(F.col("v") == "d", "error").otherwise("text"))
    assert merges.without_errors(kinds).where("v is not null").count() == 3


def test_features_by_hand(spark):
    x = features.unary(C.from_matrix(spark, [["name", "n"], ["ab", "12"], ["cd", None], ["ef", "xy"]]), date=F.lit(False))
    got = {(r.r, r.c): r for r in x.collect()}
    assert len(x.columns) == 3 + 67 and len(features.selected(x).columns) == 3 + 49
    a = got[1, 1]
    assert (a.is_number, a.is_int, a.length, a.digits, a.row_filled, a.col_filled, a.neighbours, a.col_outlier) == (1, 1, 2, 2, 1.0, 0.75, 2, 1)
    assert (got[2, 1].is_na, got[2, 1].neighbours, got[2, 0].row_alone, got[3, 1].isolated, got[0, 0].col_alike, got[1, 0].row_numbers) == (1, 3, 1, 0, 1.0, 0.5)
    pairs = {(r.r, r.c, r.r2, r.c2): r for r in features.pairwise(x).collect()}
    assert len(pairs) == 4 + 6
    p = pairs[1, 0, 1, 1]
    assert (p.same_row, p.same_col, p.is_after, p.number_string, p.d_length, p.same_font) == (1, 0, 1, 1, 0, 1)
    assert pairs[1, 1, 2, 1].one_na == 1 and pairs[0, 0, 1, 0].is_after == 0
    assert all(r.is_after == 1 for r in features.pairwise(x, compatible=False).collect())


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_box_algebra(spark):
    a, b, far = boxes.box(0, 0, 3, 3), boxes.box(2, 2, 5, 4), boxes.box(9, 9, 9, 9)
    assert one(spark, boxes.area(a)) == 16 and one(spark, boxes.overlap_area(a, b)) == 4
    assert one(spark, boxes.iou(a, b)) == 4 / 24 and one(spark, boxes.iou(a, far)) == 0
    assert tuple(one(spark, boxes.union(a, b))) == (0, 0, 5, 4) and tuple(one(spark, boxes.intersection(a, b))) == (2, 2, 3, 3) and one(spark, boxes.intersection(a, far)) is None
    assert one(spark, boxes.contains(a, boxes.box(1, 1, 4, 3), 1)) and not one(spark, boxes.contains(a, b))
    assert tuple(one(spark, boxes.edge_slice(a, "bottom", 1, 2))) == (1, 0, 2, 3) and tuple(one(spark, boxes.edge_slice(a, "left"))) == (0, 0, 3, 0)
    assert one(spark, boxes.nearly_same(a, boxes.box(1, 0, 3, 5), 1, "rows")) and not one(spark, boxes.nearly_same(a, boxes.box(1, 0, 3, 5), 1))


def test_matchers_differ(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.6), (1, 0, 1, 0.9), (1, 1, 0, 0.55), (1, 1, 1, 0.95), (2, 0, 0, 0.5), (2, 0, 1, 0.5)], "s long, pi int, gi int, iou double")
    best = sorted((r.s, r.pi, r.gi) for r in boxes.best_first(pairs, ["s"]).collect())
    first = sorted((r.s, r.pi, r.gi) for r in boxes.first_fit(pairs, ["s"], 0.5).collect())
    assert best == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]
    assert first == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]
    assert sorted((r.pi, r.gi) for r in boxes.first_fit(pairs.where("s = 1"), ["s"], 0.58).collect()) == [(0, 0), (1, 1)]
    odd = spark.createDataFrame([(1, 0, 0, 0.6), (1, 1, 0, 0.9)], "s long, pi int, gi int, iou double")
    assert boxes.best_first(odd, ["s"]).first().pi == 1 and boxes.first_fit(odd, ["s"], 0.5).first().pi == 0


def test_truncated_totals(spark):
    counts = spark.createDataFrame([(1, 0, 3, 3)], "s long, fold int, n_pred int, n_gt int")
    matches = spark.createDataFrame([(1, 0, 0.8)], "s long, fold int, iou double")
    scores = metrics.table_scores(matches, counts, ["s", "fold"], (0.5,))
    assert [r.tp for r in metrics.rolled_up(scores, []).collect()] == [1]
    assert [r.tp for r in metrics.rolled_up(scores, [], truncated=True).collect()] == [0]
    assert scores.first().mean_iou == pytest.approx(0.8 / 5)


def test_folds(spark):
    import numpy as np

    got = [(r.pos, r.fold) for r in metrics.make_folds(spark, 13).collect()]
    assert [p for p, _ in got] == np.random.RandomState(2112).permutation(13).tolist()
    assert [sum(f == k for _, f in got) for k in range(5)] == [3, 3, 3, 2, 2]


def test_encodings(spark):
    cells = C.from_matrix(spark, [["a", "a", "b"], ["a", "a", " "], ["a", "", None]])
    assert encode.index_text(cells).first().text == "(a|A1:B2)\n(a|A3)\n(b|C1)\n( |C2)"
    assert encode.plain_text(C.dense(cells)).first().text == "|A1,a|B1,a|C1,b|\n|A2,a|B2,a|C2, |\n|A3,a|B3,|C3,|"
    attrs = C.dense(cells).withColumn("attrs", F.array(F.lit("FontBold"), F.lit("TopBorder")))
    assert encode.plain_text(attrs.where("r = 0"), "attrs").first().text.endswith("\n\nFormat Input:\n|A1,FontBold,TopBorder|B1,FontBold,TopBorder|C1,FontBold,TopBorder|")


def grid_of(spark, lines, sheet=0):
    return spark.createDataFrame([(sheet, r, c, int(x)) for r, line in enumerate(lines) for c, x in enumerate(line)], "sheet_id long, r int, c int, label int")


def found(spark, lines, **rules):
    return [(r.r0, r.c0, r.r1, r.c1) for r in tables.detect(grid_of(spark, lines), tables.Rules(**rules)).orderBy("idx").collect()]


def test_table_detection(spark):
    body = ["222"] * 3
    assert found(spark, ["111", *body]) == [(0, 0, 3, 2)]
    assert found(spark, [*body, *["222"] * 4]) == [(0, 0, 6, 2)]  # 21 data cells need no header
    assert found(spark, [*["22222"] * 3, "22220"]) == []  # 19 do
    assert found(spark, ["1111", *["2222"] * 4, "0000", "0000", "0000", *["2222"] * 4]) == [(0, 0, 11, 3)]  # three empty rows join
    assert found(spark, ["1111", *["2222"] * 5, *["0000"] * 4, *["2222"] * 5]) == [(0, 0, 5, 3), (10, 0, 14, 3)]
    assert found(spark, ["1111", *["2222"] * 5, *["0000"] * 2, "1111", *["2222"] * 5]) == [(0, 0, 5, 3), (8, 0, 13, 3)]  # a header below parts
    assert found(spark, ["3333", "0111", "1222", "1222", "1222"]) == [(1, 0, 4, 3)]
    assert found(spark, ["11111111"]) == [(0, 0, 0, 7)] and found(spark, ["1111111"]) == []


def test_components():
    import numpy as np

    mask = np.array([[1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 1, 1], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    got = tables.label_components(mask)
    assert got.max() == 3 and len(set(got[mask])) == 3 and got[0, 0] == got[0, 3] and (got[~mask] == 0).all()
    assert tables.label_components(np.zeros((2, 0), bool)).shape == (2, 0)


def test_regions(spark):
    cells = C.from_matrix(spark, [["I", "I", "F"], ["I", None, "F"], ["F", "I", "I"]]).withColumn("type", F.col("v"))
    got = [(r.type, r.r0, r.c0, r.r1, r.c1, r.n) for r in tables.typed_regions(cells).orderBy("idx").collect()]
    assert got == [("I", 0, 0, 1, 1, 3), ("F", 0, 2, 1, 2, 2), ("F", 2, 0, 2, 0, 1), ("I", 2, 1, 2, 2, 2)]
