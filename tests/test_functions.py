import datetime

from pyspark.sql import functions as F

from quadrille.functions import address as A
from quadrille.functions import style, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(frame, expr):
    return [r.y for r in frame.select("i", expr.alias("y")).orderBy("i").collect()]


def test_letters_round_trip(spark):
    x = spark.range(18278).select(F.col("id").cast("int").alias("x"))
    assert x.where(A.column_index(A.letters(F.col("x"))) != F.col("x")).count() == 0
    frame = column(spark, [0, 25, 26, 701, 702, 16383, -1, 18278], "int")
    assert values(frame, A.letters(F.col("x"))) == ["A", "Z", "AA", "ZZ", "AAA", "XFD", None, None]
    assert values(column(spark, ["a", "xfd", "", "A1", "é"]), A.column_index(F.col("x"))) == [0, 16383, None, None, None]


def test_ranges(spark):
    frame = column(spark, ["A1:B2", "B2:A1", "C3", " a1 : b2 ", "A:J11", "A1:B2:C3", "", None, "A0", "A99999999999:B2"])
    got = values(frame, A.parse_range(F.col("x")))
    assert [tuple(b) if b else None for b in got] == [(0, 0, 1, 1), (0, 0, 1, 1), (2, 2, 2, 2), (0, 0, 1, 1), None, None, None, None, (-1, 0, -1, 0), None]
    assert tuple(values(frame, A.parse_range(F.col("x"), "pair"))[1]) == (1, 1, 0, 0)
    assert tuple(values(frame, A.parse_range(F.col("x"), "sentinel"))[2]) == (-1, -1, -1, -1)
    assert values(frame.limit(3), A.format_range(A.parse_range(F.col("x")))) == ["A1:B2", "A1:B2", "C3"]
    assert values(frame.limit(3), A.format_range(A.parse_range(F.col("x")), False))[2] == "C3:C3"


def test_answers(spark):
    frame = column(spark, ["['B2:E11']", "]['A3:' 'J40']", "A:J11", "a1 and 'B2':c3, 12:D4", "", None])
    found = A.found_ranges(F.col("x"))
    assert values(frame, found) == [["B2:E11"], ["A3", "J40"], ["J11"], ["A1", "B2:C3", "D4"], [], None]
    assert values(frame.limit(3), A.corners_merged(F.col("x"))) == [True, False, False]
    assert values(frame.limit(4), A.no_valid_range(found)) == [False, True, True, False]


def test_cell_types(spark):
    cases = {"": "empty", "5": "int", "1_000": "int", "5f": "string", "1d": "string", "1,234": "float", "1.234,5": "float", "nan": "float", "inf": "float", "=A1": "formula", "abc": "string", "1 000": "int", "1 000": "int", "-3.5e2": "float", ".5": "float", "5.": "float", "1e5": "float", "+7": "int", "--7": "string"}
    frame = column(spark, list(cases))
    assert values(frame, text.cell_type(F.col("x"), date=F.lit(False))) == list(cases.values())
    dated = dict(zip(["5", "31", "99", "2020", "52000", "0", "1 Jan 2020", "2020-01-05", "abc", "1,234"], values(column(spark, ["5", "31", "99", "2020", "52000", "0", "1 Jan 2020", "2020-01-05", "abc", "1,234"]), text.cell_type(F.col("x")))))
    assert dated == {"5": "date", "31": "date", "99": "date", "2020": "date", "52000": "int", "0": "int", "1 Jan 2020": "date", "2020-01-05": "date", "abc": "string", "1,234": "date"}


def test_data_types(spark):
    cases = {"1999": "Year", "2150": "IntNum", "1,234": "IntNum", "-5": "IntNum", "5%": "Percentage", "1e5": "ScientificNum", ".5": "FloatNum", "1,234.5": "FloatNum", "12:30": "TimeData", "1/2/2020": "DateData", "3-Jan-20": "DateData", "$5": "CurrencyData", "a@b.co": "EmailData", "hello": None, "": None}
    frame = column(spark, list(cases))
    assert values(frame, text.data_type(F.col("x"))) == list(cases.values())
    nf = {"0%": "Percentage", "0.0E+00": "ScientificNum", "yyyy": "DateData", "h:mm": "TimeData", "$0": "CurrencyData", "0.00": "IntNum", "General": "Year"}
    frame = spark.createDataFrame([(i, "1999", f) for i, f in enumerate(nf)], "i int, x string, f string")
    assert values(frame, text.data_type(F.col("x"), F.col("f"))) == list(nf.values())


def test_text(spark):
    frame = column(spark, ["aB1 é-", "", "９x", "  "])
    assert [tuple(t) for t in values(frame, text.text_stats(F.col("x")))] == [(6, 1, 3, 1, 1), (0, 0, 0, 0, 0), (2, 1, 1, 0, 0), (2, 0, 0, 2, 0)]
    assert values(column(spark, ["a*b", "**", "", "x"]), text.character_ratios(F.col("x"))["special"]) == [0.5, 1.0, 0.0, 0.0]
    assert values(column(spark, ["", "abc", "x" * 9]), text.token_estimate(F.col("x"))) == [1, 1, 2]
    for empty, want in ((text.is_empty_for_compression, [True, True, True, False]), (text.is_empty_for_features, [True, True, False, False]), (text.is_empty_exactly, [True, False, False, False])):
        assert values(column(spark, [None, "  ", "None", "x"]), empty(F.col("x"))) == want


def test_style(spark):
    import hashlib

    names = ["Arial", "Times New Roman", "宋体", "", None]
    want = [0.0 if not n else int(hashlib.md5(n.encode()).hexdigest(), 16) % 1_000_000 / 1_000_000 for n in names]
    assert values(column(spark, names), style.stable_hash(F.col("x"))) == want
    colours = {"#ff8000": (255, 128, 0), " #F80 ": (255, 136, 0), "red": (255, 0, 0), "transparent": None, "#12": None, "": None}
    assert [tuple(c) if c else None for c in values(column(spark, list(colours)), style.hex_colour(F.col("x")))] == list(colours.values())
    assert values(column(spark, ["12pt", "16px", "2em", "50%", "9", "x", None]), style.font_points(F.col("x"))) == [12.0, 12.0, 24.0, 6.0, 9.0, 0.0, 0.0]
    rows = spark.createDataFrame([(0, "FF102030", None, None, None), (1, None, 4, None, None), (2, None, 4, -0.5, None), (3, None, 1, 0.5, None), (4, None, None, None, 2), (5, "zz", 1, None, None), (6, None, None, None, 99)], "i int, a string, t int, d double, n int")
    got = values(rows, style.theme_colour(F.col("a"), F.col("t"), F.col("d"), F.col("n")))
    assert [tuple(c) if c else None for c in got] == [(16, 32, 48), (79, 129, 189), (39, 64, 94), (127, 127, 127), (255, 0, 0), None, None]
    assert [tuple(c) if c else None for c in values(column(spark, [2, 64, 9, 40], "int"), style.palette_colour(F.col("x")))] == [(255, 0, 0), None, (255, 255, 255), None]
    uuid = "12345678-1234-1234-1234-123456789abc"
    assert values(column(spark, [f"/x/annotations_{uuid}.npz", "/x/none.npz"]), style.file_uuid(F.col("x"))) == [uuid, None]
    assert values(column(spark, ["/x/annotations_a.b.npz"]), style.annotation_key(F.col("x"))) == ["a.b.csv"]


def test_date_parser_is_pinned(spark):
    assert datetime.datetime(2000, 1, 31)  # a month of 31 days is the default
    assert values(column(spark, ["31", "Feb", "nope", None]), text.is_date(F.col("x"))) == [True, True, False, False]
