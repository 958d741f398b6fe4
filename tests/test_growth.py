import numpy as np
from pyspark.sql import functions as F

from quadrille.operators import growth
from quadrille.plans import detection
from quadrille.sources import cells as C


def boxes(spark, lines):
    rows = [[None if x == "." else {"t": "Total value", "n": "12"}.get(x, x) for x in line] for line in lines]
    return [tuple(r.box) for r in growth.detect_boxes(C.from_matrix(spark, rows)).orderBy("idx").collect()]


def test_tables_apart(spark):
    lines = ["ttt....", "nnn....", "nnn....", ".......", ".......", ".......", "....ttt", "....nnn", "....nnn", "....nnn"]
    assert boxes(spark, lines) == [(0, 0, 2, 2), (6, 4, 9, 6)]


def test_title_and_small_things(spark):
    assert boxes(spark, ["t......", "ttttttt", "nnnnnnn", "nnnnnnn", "nnnnnnn"]) == [(1, 0, 4, 6)]
    assert boxes(spark, ["n......", ".......", ".....n."]) == []
    assert boxes(spark, ["..."]) == []


def test_gaps_and_sums():
    mask = np.array([[1, 0, 0, 1, 0, 0, 0, 1]], bool)
    assert growth.closed(mask, 2).astype(int).tolist() == [[1, 1, 1, 1, 0, 0, 0, 1]]
    rng = np.random.default_rng(0)
    full = rng.random((7, 9)) < 0.4
    s = growth.Sheet(full, full, full)
    assert s.count(1, 2, 4, 5) == full[1:5, 2:6].sum() and s.count(-3, -3, 99, 99) == full.sum() and s.count(5, 5, 4, 4) == 0


def test_values_and_lines(spark):
    cells = spark.createDataFrame([(0, 0, 0, "Year", ["TopBorder", "LeftBorder", "RightBorder", "FillColor"]), (0, 0, 1, "12", []), (0, 1, 0, " ", None)], "sheet_id long, r int, c int, v string, attrs array<string>")
    got = {(r.r, r.c): (r.content, r.border, r.fill, r.value, r.header_like) for r in growth.cell_values(cells, "attrs").collect()}
    assert got == {(0, 0): (2, 4, 2, 8, True), (0, 1): (2, 0, 0, 2, False), (1, 0): (0, 0, 0, 0, False)}
    lines = growth.boundary_lines(C.dense(growth.cell_values(cells, "attrs").select("sheet_id", "r", "c", "value")))
    assert [(r.i, r.n) for r in lines.collect()] == [(0, 2)]


def test_detect_then_encode(spark):
    rows = [[None] * 40 for _ in range(60)]
    for r in range(30, 36):
        rows[r][20:24] = ["Name", "Group", "Sum", "Note"] if r == 30 else ["a", "b", "5", str(r)]
    cells = C.from_matrix(spark, rows)
    found = growth.detect_boxes(cells)
    assert [tuple(r.box) for r in found.collect()] == [(30, 20, 35, 23)]
    text = detection.encoded(cells, *detection.kept_axes(cells, found)).first().text
    assert text.startswith("(Name|A1)\n(Group|B1)") and "(5|C2:C6)" in text


def test_on_events(spark):
    sheets = C.event_sheets(spark, "/root/testdata/sf0.001")
    found = growth.detect_boxes(sheets)
    assert found.count() > 0
    assert found.where("box.r1 <= box.r0 or box.c1 <= box.c0").count() == 0
    assert found.alias("a").join(found.alias("b"), "sheet_id").where(F.expr("a.idx < b.idx and a.box.r0 <= b.box.r1 and b.box.r0 <= a.box.r1 and a.box.c0 <= b.box.c1 and b.box.c0 <= a.box.c1")).count() == 0


def test_a_cell_at_the_far_corner(spark):
    """Arrays grow with lines that have cells: a stray cell at the end of the largest sheet costs nothing and moves no box."""
    table = [(0, r, c, "Name" if r == 5 else str(r * c)) for r in range(5, 12) for c in range(3, 8)]
    far = table + [(0, 1_048_575, 16_383, "x"), (0, 900_000, 2, "y")]
    for rows in (table, far):
        found = growth.detect_boxes(spark.createDataFrame(rows, "sheet_id long, r int, c int, v string"))
        assert [tuple(r.box) for r in found.collect()] == [(5, 3, 11, 7)]


def test_squeezed_lines():
    new, back = growth.squeezed(np.array([0, 3, 3, 40, 41, 1000]), growth.APART)
    assert new.tolist() == [0, 3, 3, 11, 12, 20] and growth.APART == 7
    assert [int(back[x]) for x in new] == [0, 3, 3, 40, 41, 1000] and (back >= 0).sum() == 5


def test_regions_against_a_plain_search():
    rng = np.random.default_rng(3)
    for shape in ((12, 9), (30, 25)):
        full = rng.random(shape) < 0.25
        sheet = growth.Sheet(full, np.zeros_like(full), full)
        for across, down in growth.GAPS:
            mask = np.zeros(shape, bool)
            for r in range(shape[0]):
                for c in range(shape[1]):
                    left, right = full[r, max(0, c - across + 1) : c + 1], full[r, c : c + across]
                    up, low = full[max(0, r - down + 1) : r + 1, c], full[r : r + down, c]
                    gap = lambda a, b, n: a.any() and b.any() and (len(a) - 1 - np.flatnonzero(a)[-1]) + np.flatnonzero(b)[0] <= n
                    mask[r, c] = full[r, c] or gap(left, right, across) or gap(up, low, down)
            want, todo = [], {(int(r), int(c)) for r, c in zip(*np.nonzero(mask))}
            while todo:
                part, queue = [], [todo.pop()]
                while queue:
                    r, c = queue.pop()
                    part.append((r, c))
                    for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                        if x in todo:
                            todo.remove(x)
                            queue.append(x)
                box = sheet.trimmed((min(r for r, _ in part), min(c for _, c in part), max(r for r, _ in part), max(c for _, c in part)))
                if box and box[2] > box[0]:
                    want.append(box)
            assert sorted(sheet.regions(across, down, False)) == sorted(want)


def test_size_changes_nothing(spark):
    """A table finds its box whether or not the sheet goes on for thousands of rows."""
    table = [(0, r, c, "Name" if r == 0 else str(r)) for r in range(6) for c in (0, 1, 4, 5)]
    more = table + [(0, r, c, str(r)) for r in range(50, 1500) for c in range(3)]
    small, large = ([tuple(r.box) for r in growth.detect_boxes(spark.createDataFrame(rows, "sheet_id long, r int, c int, v string")).collect()] for rows in (table, more))
    assert small == [(0, 0, 5, 5)] and large == [*small, (50, 0, 1499, 2)]
