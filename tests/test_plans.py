import json

import numpy as np
from pyspark.sql import functions as F

from quadrille.functions.address import parse_range
from quadrille.operators import models
from quadrille.plans import detection, queries
from quadrille.sources import cells as C
from quadrille.streaming import sheets


def sheet(spark):
    rows = [[None] * 6 for _ in range(30)]
    for r in range(10, 14):
        rows[r] = [None, "h" if r == 10 else "1", "h" if r == 10 else "2", None, None, "far"]
    rows[25][1] = "x"
    return C.from_matrix(spark, rows, 7)


def box_table(spark, *ranges):
    return spark.createDataFrame([(7, i, r) for i, r in enumerate(ranges)], "sheet_id long, idx int, range string").withColumn("box", parse_range(F.col("range")))


def test_encode_answer_and_lift(spark):
    cells, found = sheet(spark), box_table(spark, "B11:C14")
    rows, columns = detection.kept_axes(cells, found, k=2)
    assert [r.oi for r in rows.orderBy("ci").collect()] == [10, 11, 12, 13] and [r.oi for r in columns.orderBy("ci").collect()] == [1, 2]
    text = detection.encoded(cells, rows, columns)
    assert text.first().text == "(h|A1:B1)\n(1|A2:A4)\n(2|B2:B4)"
    answers = detection.parsed(detection.answered(text, lambda prompts: ["['a1':'B4']" if p.endswith("(2|B2:B4)") else "none" for p in prompts]))
    a = answers.first()
    assert (a.ranges, a.corners_merged, a.invalid) == (["A1:B4"], True, False)
    boxes_ = answers.select("sheet_id", F.posexplode("ranges").alias("idx", "range")).withColumn("box", parse_range(F.col("range")))
    back = detection.moved(boxes_, rows, columns, "original")
    assert tuple(back.first().box) == (10, 1, 13, 2)
    lines = detection.training_lines(text, box_table(spark, "B11:C14", "B1:C2"), rows, columns)
    line = json.loads(lines.first().line)
    assert [m["role"] for m in line["messages"]] == ["user", "assistant"] and line["messages"][1]["content"] == "['range': 'A1:B4', 'range': 'A1:B1']"
    assert detection.line_statistics(lines).first().lines == 1


def test_axes_without_boxes(spark):
    cells = sheet(spark)
    rows, _ = detection.kept_axes(cells, box_table(spark, "B11:C14").where("false"))
    assert [r.oi for r in rows.orderBy("ci").collect()] == [10, 11, 12, 13, 14, 24, 25]


def test_replay_and_conversion(spark, tmp_path):
    rows = [
        ("f1", None, 0, ["A1:B2", "A1:B2", "C1"], ["A1:B2", "C1:D2"], None),
        ("f2", "s", 1, ["A1:B3"], ["A1:B4"], None),
        ("f3", "s", 1, None, ["A1:B4"], "broken"),
    ]
    records = spark.createDataFrame(rows, "file_path string, sheet_name string, fold int, predicted_ranges array<string>, gt_ranges array<string>, error string")
    got = {(r.threshold, r.fold): (r.tp, r.fp, r.fn) for r in detection.micro(detection.replayed(records), ["fold"]).collect()}
    assert got[1.0, None] == (1, 3, 3) and got[0.5, None] == (2, 2, 2) and got[0.75, 1] == (1, 0, 1) and got[0.95, 1] == (0, 1, 2)
    out = detection.converted(records).collect()
    assert [(r.fold, r.n_predicted, r.n_gt) for r in out] == [("fold_01", 2, 2), ("fold_02", 1, 1)]
    done = spark.createDataFrame([("f1",)], "file_path string")
    detection.write_results(records, str(tmp_path / "r"), done, "file_path")
    assert {r.file_path for r in spark.read.json(str(tmp_path / "r")).collect()} == {"f2", "f3"}


def test_grids_and_caches(spark, tmp_path):
    labels = spark.createDataFrame([(0, "u", r, c, 1) for r in range(2) for c in range(3)] + [(0, "v", 0, 0, 1)], "fold int, uuid string, r int, c int, label int")
    shapes = spark.createDataFrame([("u", 2, 3), ("v", 2, 2), ("w", 1, 1)], "uuid string, n_rows int, n_cols int")
    status = {r.uuid: r.status for r in detection.write_grids(labels, shapes, str(tmp_path / "g")).collect()}
    assert status == {"u": "ok", "v": "shape_mismatch", "w": "shape_mismatch"}
    assert [r.uuid for r in detection.stale(shapes.where("uuid <> 'w'"), shapes, "uuid").collect()] == ["w"]


def toy(spark, sheets_=12, seed=0):
    """Grids whose first row is a header, whose rest is data, with some empty cells; features are noisy."""
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for s in range(sheets_):
        for r in range(4):
            for c in range(4):
                empty = rng.random() < 0.2
                y = 0 if empty else 1 if r == 0 else 2
                nodes.append((s, r, c, [float(empty), float(r == 0) + rng.normal(0, 0.4), 1.0], y, empty))
                edges += [(s, r, c, r2, c2, [float(r == r2), 1.0]) for r2, c2 in ((r, c + 1), (r + 1, c)) if r2 < 4 and c2 < 4]
    return spark.createDataFrame(nodes, "sheet_id long, r int, c int, x array<double>, y int, is_empty boolean"), spark.createDataFrame(edges, "sheet_id long, r int, c int, r2 int, c2 int, f array<double>")


def test_grid_model(spark, tmp_path):
    nodes, edges = toy(spark)
    model, log = models.grid_fit(nodes, edges, models.GridModel(3, 2), rounds=6, validation=toy(spark, 6, 1))
    assert log[0]["loss"] >= log[-1]["loss"] and max(r["macro_f1"] for r in log) > 0.9
    test, links = toy(spark, 8, 2)
    scored = test.join(models.grid_predict(test, links, model), ["sheet_id", "r", "c"])
    assert scored.where("(yhat = 0) <> is_empty").count() == 0
    assert scored.where("y <> yhat").count() < 0.15 * scored.count()
    models.save(model, spark, str(tmp_path / "m"))
    assert np.array_equal(models.load(spark, str(tmp_path / "m")).w, model.w)


def test_max_product_is_exact_on_a_chain():
    rng = np.random.default_rng(3)
    unary, pair = rng.normal(size=(6, 3)), rng.normal(size=(5, 3, 3))
    edges = np.array([(i, i + 1) for i in range(5)])
    best = max(np.ndindex(*[3] * 6), key=lambda s: sum(unary[i, x] for i, x in enumerate(s)) + sum(pair[i, s[i], s[i + 1]] for i in range(5)))
    assert models.max_product(unary, pair, edges, 60).tolist() == list(best)


def test_forest_and_weights(spark):
    from quadrille.operators.features import unary

    grid = spark.createDataFrame([(s, r, c, ("h" if r == 0 else str(r * c + s)) if (r + c) % 3 else None) for s in range(6) for r in range(5) for c in range(4)], C.CELLS)
    x = unary(grid, date=F.lit(False)).withColumn("y", F.when(F.col("is_na") == 1, 0).when(F.col("r") == 0, 1).otherwise(2))
    rows = models.with_weights(x).cache()
    fitted = models.forest("selected", trees=5, depth=4).fit(rows)
    scored = models.probabilities(fitted.transform(rows), 3)
    assert scored.where("prediction = y").count() > 0.9 * rows.count()
    assert models.weighted_loss(scored.withColumn("yhat", F.col("prediction").cast("int")), ["sheet_id"]).where("loss > most").count() == 0
    assert models.continuous_loss(scored, ["sheet_id"]).where("loss < 0").count() == 0
    p = spark.range(1).select(models.clamped(F.array(F.lit(0.1), F.lit(0.2)), F.lit(True), 10.0).alias("a"), models.clamped(F.array(F.lit(0.1), F.lit(0.2)), F.lit(False), 10.0).alias("b")).first()
    assert p.a[0] == 0.1 and p.a[1] < -9 and p.b[0] < -9 and p.b[1] == 0.2


def test_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = sheets.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.start, r.event_type): r.n for r in sheets.windowed(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == want
    assert sum(r.n for r in sheets.sessions(events).collect()) == events.count()
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.csv").write_text("x,y\n1,2\n")
    for _ in range(2):
        q = sheets.write_cells(spark, str(tmp_path / "files"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4




def test_keys_and_styles(spark):
    u = [f"0000000{i}-0000-0000-0000-000000000000" for i in range(4)]
    manifest = spark.createDataFrame([("/a/One.xls", u[0], 0), ("/b/one.XLS", u[1], 1), ("/c/two.ods", u[2], 2)], "file_path string, uuid string, position int")
    records = spark.createDataFrame([(f"/x/annotations_{u[3]}.npz", "q.csv"), (None, f"/y/{u[3]}.csv"), (None, "/z/ONE.xls"), (None, "two.csv"), (None, "none.csv")], "labels_path string, file_path string")
    got = {r.file_path: r.key for r in detection.canonical_keys(records, manifest).collect()}
    assert got == {"q.csv": u[3], f"/y/{u[3]}.csv": u[3], "/z/ONE.xls": u[1], "two.csv": u[2], "none.csv": None}
    styles = spark.createDataFrame([("a", "b", "size", "9"), ("b", "c", "size", "10"), ("b", "c", "font", "X"), ("c", "a", "bold", "1")], "name string, parent string, property string, value string")
    got = {(r.name, r.property): r.value for r in detection.resolved_styles(styles).collect()}
    assert got["a", "size"] == "9" and got["a", "font"] == "X" and got["a", "bold"] == "1" and got["c", "size"] == "9" and len(got) == 9


SF = "/root/testdata/sf0.001"


def event_lines(spark, axis):
    found = {}
    for r in C.event_sheets(spark, SF).collect():
        found.setdefault(r.sheet_id, set()).add(r[axis])
    return found


def kept_lines(lines, keep, size):
    out, empty = [], 0
    for i in range(size):
        empty = 0 if i in lines else empty + 1
        if empty <= keep:
            out.append(i)
    return out


def test_nearest_kept_row_of_every_row(spark):
    want = set()
    for sheet_id, lines in event_lines(spark, "r").items():
        kept = kept_lines(lines, 2, max(lines) + 1)
        for x in range(max(lines) + 1):
            want.add((sheet_id, x, min(range(len(kept)), key=lambda k: (abs(kept[k] - x), kept[k]))))
    assert {tuple(r) for r in queries.nearest_kept_row(spark, SF).collect()} == want


def test_merged_values_of_all_columns(spark):
    cells = {(r.sheet_id, r.r, r.c): r.v for r in C.order_sheets(spark, SF).collect()}
    want = {k: cells[k[0], k[1], 1] if k[1] % 2 == 0 and k[2] == 2 else v for k, v in cells.items()}
    assert {(r.sheet_id, r.r, r.c): r.v for r in queries.merged_values(spark, SF).collect()} == want


def test_columns_collapsed_keep_all_events(spark):
    want = set()
    for sheet_id, columns in event_lines(spark, "c").items():
        moved = {3 * c + 2 * (c > sheet_id % 5) for c in columns}
        want |= {(sheet_id, k, i) for k, i in enumerate(kept_lines(moved, 2, 16))}
    assert {tuple(r) for r in queries.columns_collapsed_with_tail(spark, SF).collect()} == want


def test_keys_of_all_methods_are_real_keys(spark):
    found = {}
    for r in C.read(spark, SF, "lineitem").select("l_linestatus", "l_returnflag", "l_partkey").distinct().collect():
        found.setdefault(r[0], {}).setdefault(r[1], set()).add(r[2])
    want = {(fold, key) for fold, methods in found.items() for key in set.intersection(*methods.values())}
    assert {(r.fold, r.key) for r in queries.keys_of_all_methods(spark, SF).collect()} == want


def test_styles_of_any_depth(spark):
    """A chain of 36 parents, and one that runs in a circle."""
    rows = [(f"s{i}", f"s{i + 1}", None, None) for i in range(36)] + [("s36", None, "size", "9"), ("s3", "s4", "bold", "1"), ("a", "b", "x", "1"), ("b", "a", "y", "2")]
    got = {(r.name, r.property): r.value for r in detection.resolved_styles(spark.createDataFrame(rows, "name string, parent string, property string, value string")).collect()}
    assert got["s0", "size"] == "9" and got["s0", "bold"] == "1" and ("s4", "bold") not in got
    assert {k: v for k, v in got.items() if k[0] in "ab"} == {("a", "x"): "1", ("a", "y"): "2", ("b", "x"): "1", ("b", "y"): "2"}


def test_reruns_add_nothing(spark, tmp_path):
    records = spark.createDataFrame([("f1", 0, "x"), ("f2", 1, "y")], "file_id string, fold int, answer string")
    path = str(tmp_path / "results")
    for more in (records, records, records.unionByName(spark.createDataFrame([("f3", 1, "z")], records.schema))):
        detection.write_results(more, path)
    assert sorted(r.file_id for r in spark.read.json(path).collect()) == ["f1", "f2", "f3"]
    grids = spark.createDataFrame([(0, "u1", r, c, "data") for r in range(2) for c in range(3)], "fold int, uuid string, r int, c int, label string")
    other = spark.createDataFrame([(0, "u2", 0, 0, "data")], grids.schema)
    shapes = spark.createDataFrame([("u1", 2, 3), ("u2", 1, 1), ("u3", 1, 1)], "uuid string, n_rows int, n_cols int")
    path = str(tmp_path / "grids")
    detection.write_grids(grids, shapes, path)
    status = {r.uuid: r.status for r in detection.write_grids(grids.unionByName(other), shapes, path).collect()}
    assert status == {"u1": "ok", "u2": "ok", "u3": "shape_mismatch"} and spark.read.parquet(path).count() == 7
