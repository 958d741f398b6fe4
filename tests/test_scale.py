"""Queries of sheets keep a sheet's cells together, whatever the number of sheets, and give the same as plain loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrille.operators import encode, growth
from quadrille.plans import detection, queries
from quadrille.sources import cells as C

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return sum("- Exchange" in line for line in plan(df).splitlines())


def drawn(spark, seed, sheets=40, values="aab", size=6):
    """Sheets full of repeated values, as (cells, {sheet: {(r, c): v}})."""
    rng = np.random.default_rng(seed)
    grids = {s: {(r, c): str(rng.choice(list(values))) for r in range(int(rng.integers(1, size + 1))) for c in range(size) if rng.random() < 0.8} for s in range(sheets)}
    return spark.createDataFrame([(s, r, c, v) for s, g in grids.items() for (r, c), v in g.items()], C.CELLS), grids


def covered(grid, value):
    """(n, r0, c0, r1, c1) of a value, one cell after another."""
    places = sorted(p for p, v in grid.items() if v == value)
    free, out = set(places), []
    for n, (r, c) in enumerate(places):
        if (r, c) in free:
            w = h = 1
            while (r, c + w) in free:
                w += 1
            while all((r + h, c + k) in free for k in range(w)):
                h += 1
            free -= {(r + a, c + b) for a in range(h) for b in range(w)}
            out.append((n, r, c, r + h - 1, c + w - 1))
    return out


def test_boxes_of_many_sheets_together(monkeypatch):
    """small sheets share an array, and have the boxes that each has alone."""
    rng = np.random.default_rng(5)
    ids = np.arange(50)
    sheets = [np.argwhere(rng.random((int(rng.integers(2, 30)), int(rng.integers(2, 7)))) < 0.4) for _ in ids]
    sheets = [s if len(s) else np.array([[0, 0]]) for s in sheets]
    calls, count = [], growth.component_runs
    monkeypatch.setattr(growth, "component_runs", lambda m: (calls.append(1), count(m))[1])

    def boxes(some):
        at = np.concatenate([sheets[i] for i in some])
        given = {"r": at[:, 0], "c": at[:, 1], "full": np.ones(len(at), bool), "marked": at.sum(1) % 7 == 0, "header_like": at[:, 0] % 4 == 0}
        cuts = np.cumsum([0] + [len(sheets[i]) for i in some])
        return [row for part in growth.stacked_boxes(np.array(some), cuts, {n: pa.array(x) for n, x in given.items()}) for row in zip(*[x.tolist() for x in part])]

    together = boxes(ids)
    assert len(calls) <= 2 * len(growth.GAPS) and len(together) > 50
    assert together == [row for i in ids for row in boxes([i])]


def test_texts_without_the_lines_between(spark):
    """a sheet without boxes keeps all its lines, but none is made that its text doesn't show."""
    far = 1_500_000_000
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b"), (1, far, 2, "c")], C.CELLS)
    found = growth.detect_boxes(cells)
    rows, columns = detection.kept_axes(cells, found.where("false"))
    assert [r.oi for r in rows.orderBy("ci").collect()] == [0, 1, 2, far - 1, far] and columns.count() == 3
    assert "sequence(" not in plan(queries.sheet_texts(spark, SF))


def test_lines_near_boxes(spark):
    """lines as the plain rule has them: near a box, numbered anew, inner empty runs cut to two."""
    cells, grids = drawn(spark, 1, 12, size=9)
    grids = {s: {(3 * r, c): v for (r, c), v in g.items()} for s, g in grids.items()}
    cells = cells.withColumn("r", F.col("r") * 3)
    boxes_ = {s: [b for b in [(s, 2, s % 4 + 3, 2 + s % 3), (12, 5, 15, 5)][: s % 3] if any(r >= b[2] for r, _ in g) and any(c >= b[3] for _, c in g)] for s, g in grids.items()}
    found = spark.createDataFrame([(s, b) for s, bs in boxes_.items() for b in bs], "sheet_id long, box struct<r0:int,c0:int,r1:int,c1:int>")
    got = [{}, {}]
    for axis, map_ in enumerate(detection.kept_axes(cells, found, k=2)):
        for m in map_.orderBy("sheet_id", "ci").collect():
            got[axis].setdefault(m.sheet_id, []).append(m.oi)
    want = [{}, {}]
    for s, g in grids.items():
        if not g:
            continue
        size = [max(p[a] for p in g) + 1 for a in (0, 1)]
        near = [[i for i in range(size[a]) if not boxes_[s] or any(abs(i - b[k]) <= 2 for b in boxes_[s] for k in (a, a + 2))] for a in (0, 1)]
        inside = [p for p in g if p[0] in near[0] and p[1] in near[1]]
        for a in (0, 1):
            own = [i for i in near[a] if any(p[a] == i for p in inside)]
            at = [near[a].index(i) for i in own]
            kept = sorted({x for i, k in enumerate(at) for x in ([k] if not i or k - at[i - 1] < 3 else [at[i - 1] + 1, k - 1, k])})
            if kept:
                want[a][s] = [near[a][k] for k in kept]
    assert got == want


def test_index_texts_deal_cells_once(spark):
    """lines are dealt by order once; the texts are those of plain loops."""
    assert exchanges(queries.index_texts(spark, SF)) == 1
    cells, grids = drawn(spark, 2)
    name = lambda r, c: f"{chr(65 + c)}{r + 1}"
    want = {}
    for s, g in grids.items():
        lines = []
        for v in set(g.values()):
            first = min(p for p in g if g[p] == v)
            lines += [(first, n, f"({v}|{name(a, b)})" if (a, b) == (c, d) else f"({v}|{name(a, b)}:{name(c, d)})") for n, a, b, c, d in covered(g, v)]
        if lines:
            want[s] = "\n".join(x[2] for x in sorted(lines))
    assert {r.sheet_id: r.text for r in encode.index_text(cells).collect()} == want
    odd = spark.createDataFrame([(1, 0, 0, "é"), (1, 0, 0, "b"), (1, 0, 20000, "x"), (1, 1, 18277, "y"), (2, 0, 0, None), (2, 0, 1, "")], C.CELLS)
    assert [tuple(r) for r in encode.index_text(odd).collect()] == [(1, "(b|A1)\n(é|A1)\n(y|ZZZ2)")]


def test_rectangles_of_any_values(spark):
    """cells are dealt once; rectangles are those of a loop over a value's places."""
    assert exchanges(queries.value_rectangles(spark, SF)) == 1
    for seed, values in ((3, "ab"), (4, "abcdefghij")):
        cells, grids = drawn(spark, seed, values=values)
        want = {(s, v, *x) for s, g in grids.items() for v in set(g.values()) for x in covered(g, v)}
        assert {tuple(r) for r in encode.rectangles(cells).collect()} == want


def test_value_index_without_lists(spark):
    """counts and first places without a list for each value, sheets held in rows or in cells."""
    x = queries.value_index(spark, SF)
    assert exchanges(x) == 1 and "collect_list" not in plan(x)
    want = {(r.sheet_id, r.v, len(r.cells), r.first.r, r.first.c) for r in encode.inverted_index(C.order_sheets(spark, SF)).collect()}
    assert {tuple(r) for r in x.collect()} == want == {tuple(r) for r in encode.value_counts(C.order_sheets(spark, SF)).collect()}


def test_tables_of_equal_sheets(spark):
    """label grids are dealt once, as rows; the tables of cells are the same."""
    from quadrille.operators import tables

    grids = queries._label_grids(spark, SF)
    x = queries.detected_tables(spark, SF)
    assert exchanges(x) == 1 and "c" not in grids.columns
    cells = grids.select("sheet_id", "r", F.posexplode("label").alias("c", "label")).orderBy(F.rand(1))
    got = x.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tables.detect(cells).collect())) and len(got) > 1000


def test_plain_texts_without_lists(spark):
    """rows become text some sheets at a time."""
    x = queries.plain_sheets(spark, SF)
    assert exchanges(x) == 1 and "collect_list" not in plan(x)
    rows = {}
    for r in C.order_sheets(spark, SF).collect():
        rows.setdefault(r.sheet_id, {}).setdefault(r.r, {})[r.c] = f"{chr(65 + r.c)}{r.r + 1},{r.v}"
    want = {s: "\n".join("|" + "|".join(line[c] for c in sorted(line)) + "|" for _, line in sorted(g.items())) for s, g in rows.items()}
    assert {r.sheet_id: r.text for r in x.collect()} == want


def test_regions_deal_rows_once(spark):
    """types go to the kernels as rows; regions are those of cells dealt anew."""
    from quadrille.functions import text
    from quadrille.operators import tables

    x = queries.type_regions(spark, SF)
    assert exchanges(x) == 1
    cells = C.order_sheets(spark, SF).withColumn("type", text.data_type(F.col("v")))
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, tables.typed_regions(cells).collect()))
    odd = ["12", "1999", "2100", "19990", "-5", "+5", "007", "N", "a@b.c", "a", "", " 12 ", "1,200", "1.5", "1e5", "12%", "1/2/1999", "5 Jan", "$5", "٣", "12\n"]
    got = [r.t for r in spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").orderBy("i").select(text.data_type(F.col("s")).alias("t")).collect()]
    assert got == ["IntNum", "Year", "IntNum", "IntNum", "IntNum", None, "IntNum", None, "EmailData", None, None, "IntNum", "IntNum", "FloatNum", "ScientificNum", "Percentage", "DateData", "DateData", "CurrencyData", None, "IntNum"]


def test_boundaries_of_cells(spark):
    """only cells are compared; a dense grid and its cells have the same boundaries on both axes."""
    assert "sequence(" not in plan(queries.row_boundaries(spark, SF))
    cells, _ = drawn(spark, 6)
    cells = cells.where("(r + c) % 3 > 0").withColumn("full", F.when(F.col("v") == "a", 1).otherwise(2))
    for axis in "rc":
        dense = C.dense(cells).withColumn("full", F.coalesce("full", F.lit(0)))
        want = {tuple(r) for r in encode.boundaries(dense, "full", axis).collect()}
        assert {tuple(r) for r in encode.boundaries(cells, "full", axis).collect()} == want and len(want) > 100


def test_dates_of_distinct_values(spark):
    """F8: lines aren't dealt by order, and each value of a column is parsed once."""
    from quadrille.functions import text

    x = queries.cell_dates(spark, SF)
    assert "l_orderkey" not in plan(x)
    want = C.order_sheets(spark, SF).select("c", text.cell_type(F.col("v")).alias("type")).groupBy("c", "type").count()
    assert {tuple(r) for r in x.collect()} == {tuple(r) for r in want.collect()}


def test_rectangle_sums_of_cells(spark):
    """sums stand at rows and columns with cells, however far apart these are."""
    rng = np.random.default_rng(7)
    cells = [(s, int(r) * 10_000_000, int(c), int(v)) for s in range(6) for r, c, v in {(a, b): (a, b, d) for a, b, d in rng.integers(0, 20, (30, 3))}.values()]
    cells += [(9, i, i, 1) for i in range(400)]  # far more places than cells
    boxes_ = [(s, i, (int(a) * 7_000_000, int(b), int(c) * 7_000_000, int(d))) for s in (*range(6), 9, 10) for i, (a, b, c, d) in enumerate(rng.integers(-3, 30, (12, 4)))]
    boxes_ += [(9, 12, (10, 0, 50, 400))]
    got = encode.rectangle_sums(spark.createDataFrame(cells, "sheet_id long, r int, c int, n int"), "n", spark.createDataFrame(boxes_, "sheet_id long, idx int, box struct<r0:int,c0:int,r1:int,c1:int>"))
    want = {(s, i, sum(n for t, r, c, n in cells if t == s and a <= r <= e and b <= c <= d)) for s, i, (a, b, e, d) in boxes_ if s != 10}
    assert {tuple(r) for r in got.collect()} == want


def test_nearest_looks_at_rows_once(spark):
    """no window reaches from each row to the end of its sheet, which takes the square of its rows."""
    assert "currentrow$(), unboundedfollowing$()" not in plan(queries.nearest_kept_row(spark, SF))


def test_grids_are_not_dealt(spark):
    """places are made beside the cells; the grid's rows don't go through an exchange."""
    import re

    assert not re.search(r"hashpartitioning\(sheet_id#\d+L, r#\d+, c#", plan(C.dense(C.event_sheets(spark, SF))))
    cells, grids = drawn(spark, 8)
    sizes = spark.createDataFrame([(s, 4, 7) for s in range(42)], "sheet_id long, n_rows int, n_cols int")
    want = sorted((s, r, c, 4, 7, grids.get(s, {}).get((r, c))) for s in range(42) for r in range(4) for c in range(7))
    got = C.dense(cells, sizes)
    assert got.columns == ["sheet_id", "r", "c", "n_rows", "n_cols", "v"] and sorted(map(tuple, got.collect())) == want
    assert C.dense(cells.where("sheet_id = 1 and r = 0 and c = 0").withColumn("c", F.lit(200_000))).count() in (0, 200_001)


def test_types_are_dealt_not_lines(spark):
    """F16: what is dealt by order is ten small numbers a line, counted some sheets at a time."""
    x = queries.column_types(spark, SF)
    assert exchanges(x) == 1 and "Window" not in plan(x) and "HashAggregate" not in plan(x)


def test_areas_in_their_sheet(spark):
    """cells of merged areas stay with their sheet, and show what the join of any areas shows."""
    import re

    from quadrille.operators import merges

    assert not re.search(r"hashpartitioning\([^)]*\br#", plan(queries.merged_values(spark, SF)))
    cells, _ = drawn(spark, 9)
    areas = cells.where("r = 1").groupBy("sheet_id").agg(F.lit(1).alias("r0"), F.min("c").alias("c0"), F.lit(2).alias("r1"), (F.min("c") + 1).alias("c1"))
    map_ = merges.merge_map(areas).join(cells.select("sheet_id", "r", "c"), ["sheet_id", "r", "c"])
    got = merges.shown(cells.join(map_, ["sheet_id", "r", "c"], "left"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, merges.with_anchor_values(cells, map_).collect()))


def test_column_letters_without_a_fold(spark):
    """letters become a number in one expression; seven letters are the most."""
    from quadrille.functions import address

    assert "aggregate(" not in plan(queries.range_parsing(spark, SF))
    odd = ["A", "z", "AA", "xfd", "ZZZZZZZ", "AAAAAAAA", "", "A1", "é", "@", " A", None]
    got = [r.i for r in spark.createDataFrame([(k, s) for k, s in enumerate(odd)], "k int, s string").orderBy("k").select(address.column_index(F.col("s")).alias("i")).collect()]
    assert got == [0, 25, 26, 16383, 26 * (26**7 - 1) // 25 - 1, None, None, None, None, None, None, None]


def test_features_without_a_dealt_grid(spark):
    """places are made in kernels; a sheet of more places than one batch has the same features as its parts say."""
    from quadrille.operators import features

    x = queries.cell_features(spark, SF)
    assert "sequence(" not in plan(x) and "Window [sum" not in plan(x) and "Join [sheet_id" not in plan(x)
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "2"), (1, 100_000, 1, "3"), (2, 0, 0, "4")], C.CELLS)
    got = features.unary(cells, date=F.lit(False), only=("is_na", "neighbours", "row_place", "col_numbers"))
    assert got.where("sheet_id = 1").count() == 200_002 and got.where("is_na = 0").count() == 4
    near = {(r.sheet_id, r.r, r.c): r.neighbours for r in got.where("neighbours > 0").collect()}
    assert near == {(1, 0, 0): 1, (1, 1, 0): 1, (1, 0, 1): 1, (1, 1, 1): 1, (1, 2, 0): 1, (1, 99_999, 1): 1, (1, 100_000, 0): 1}
    last = got.where("r = 100000 and c = 1").first()
    assert (last.row_place, last.col_numbers) == (100_000 / 100_001, 1.0)


def test_neighbours_in_one_kernel(spark):
    """lines are dealt once; pairs are those of the features of every place."""
    from quadrille.operators import features

    x = queries.neighbour_features(spark, SF)
    assert exchanges(x) == 2 and "Window [lead" not in plan(x)  # lines, and sums by sheet
    names = ("same_row", "d_length", "both_number", "number_string", "one_na", "is_after")
    cells, _ = drawn(spark, 10, values=["a", "12", "bcd", "-4.5"])
    want = features.pairwise(features.unary(cells, date=F.lit(False))).select("sheet_id", "r", "c", "r2", "c2", *names)
    assert sorted(map(tuple, features.neighbours(cells, names, F.lit(False)).collect())) == sorted(map(tuple, want.collect()))
