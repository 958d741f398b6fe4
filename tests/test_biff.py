import struct

from pyspark.sql import functions as F

from quadrille.operators import features, merges
from quadrille.sources import biff, files, workbooks


def record(kind, body):
    out = struct.pack("<HH", kind, min(len(body), 8000)) + body[:8000]
    for at in range(8000, len(body), 8000):
        out += struct.pack("<HH", biff.CONTINUE, len(body[at : at + 8000])) + body[at : at + 8000]
    return out


def text(s, wide=2):
    raw = s.encode("utf-16-le")
    return struct.pack("<H" if wide == 2 else "<B", len(s)) + b"\x01" + raw


def workbook():
    strings = ["name", "ü" * 3, "last"]
    sst = struct.pack("<II", 3, 3) + b"".join(text(s) for s in strings)
    font = lambda weight, colour, name: record(biff.FONT, struct.pack("<HHHHHBBBB", 240, 2, colour, weight, 0, 1, 0, 0, 0) + text(name, 1))
    xf = lambda f, nf, border, fill, bg: record(biff.XF, struct.pack("<HHHBBBBIIH", f, nf, 0, 2 | 1 << 4, 0, 0, 0, border, fill, bg))
    globals_ = record(biff.BOF, struct.pack("<HH", 0x600, 5) + bytes(12)) + font(700, 10, "Arial") + record(biff.FORMAT, struct.pack("<H", 164) + text("yyyy-mm-dd"))
    globals_ += record(biff.PALETTE, struct.pack("<H", 3) + bytes([0, 0, 0, 0, 1, 2, 3, 0, 255, 0, 0, 0]))
    globals_ += xf(0, 0, 1 | 1 << 8, 1 << 26, 9) + xf(0, 164, 0, 0, 9)
    rest = record(biff.SST, sst) + record(biff.EOF, b"")
    body = record(biff.BOF, struct.pack("<HH", 0x600, 0x10) + bytes(12))
    body += record(biff.LABELSST, struct.pack("<HHHI", 0, 0, 0, 0)) + record(biff.LABELSST, struct.pack("<HHHI", 0, 1, 0, 1))
    body += record(biff.NUMBER, struct.pack("<HHHd", 1, 0, 1, 44197.0)) + record(biff.RK, struct.pack("<HHHI", 1, 1, 0, 1234 << 2 | 3))
    body += record(biff.MULRK, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, 7 << 2 | 2) + struct.pack("<HI", 0, 8 << 2 | 2) + struct.pack("<H", 1))
    body += record(biff.BOOLERR, struct.pack("<HHHBB", 3, 0, 0, 1, 0)) + record(biff.BOOLERR, struct.pack("<HHHBB", 3, 1, 0, 7, 1))
    body += record(biff.FORMULA, struct.pack("<HHH", 4, 0, 0) + b"\0" * 6 + b"\xff\xff" + bytes(8)) + record(biff.STRING, text("made"))
    body += record(biff.FORMULA, struct.pack("<HHHd", 4, 1, 0, 2.5) + bytes(8)) + record(biff.MERGED, struct.pack("<HHHHH", 1, 0, 0, 0, 2)) + record(biff.EOF, b"")
    size = len(record(biff.BOUNDSHEET, struct.pack("<IBB", 0, 0, 0) + text("Sheet 1", 1)))
    sheet = record(biff.BOUNDSHEET, struct.pack("<IBB", len(globals_) + size + len(rest), 0, 0) + text("Sheet 1", 1))
    return globals_ + sheet + rest + body


def compound(stream):
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    stream = stream.ljust(n * 512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [i + 3 for i in range(n - 1)] + [0xFFFFFFFE]
    entry = lambda name, kind, start, length: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", start, length))
    folder = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + bytes(256)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + folder + stream


def plain(sheet):
    return {k: x.v for k, x in sheet.cells.items() if x.v is not None}


def test_profiles():
    data = compound(workbook())
    one = workbooks.read("a.xls", data, "Sheet1")
    assert plain(one) == {(0, 0): "name", (0, 1): "name", (0, 2): "name", (1, 0): "44197", (1, 1): "12.34", (2, 0): "7", (2, 1): "8", (3, 0): "True", (4, 0): "made", (4, 1): "2.5"}
    other = workbooks.read("a.xls", data, profile="encoder")
    assert plain(other)[1, 0] == "2021-01-01 00:00:00" and plain(other)[0, 1] == "üüü" and plain(other)[2, 0] == "7.0" and other.merges == []
    assert other.cells[1, 0].nf == "yyyy-mm-dd"


def test_strings_over_continuations():
    long = "é" * 5000
    body = struct.pack("<II", 1, 1) + struct.pack("<HB", 5000, 1)
    raw = long.encode("utf-16-le")
    parts = [body + raw[:6000], b"\x01" + raw[6000:]]
    assert biff._Parts(parts, 8).text() == long
    mixed = [struct.pack("<HB", 6, 0) + b"abc", b"\x01" + "déf".encode("utf-16-le")]
    assert biff._Parts(mixed).text() == "abcdéf"
    assert (biff.rk(7 << 2 | 2), biff.rk(1234 << 2 | 3), biff.rk((-5 << 2 | 2) & 0xFFFFFFFF)) == (7.0, 12.34, -5.0)


def test_formats(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(compound(workbook()))
    cells, areas, failed = files.split_cells(files.sheets(spark, str(tmp_path)))
    assert failed.count() == 0
    known = files.styles(spark, str(tmp_path)).withColumn("sheet_id", F.xxhash64("file_path", "sheet"))
    looks = features.formats(cells, known, merges.merge_map(areas))
    got = {(r.r, r.c): r for r in looks.collect()}
    a = got[0, 1]
    assert (a.bold, a.italic, a.underline, a.font_size, a.in_merge, a.border_left, a.border_right, a.border_top) == (1, 1, 1, 12.0, 1, 1, 0, 1)
    assert (a.fg_r, a.fg_g, a.bg_r, a.bg_b) == (1.0, 0.0, 1 / 255, 3 / 255) and got[1, 0].bg_r == -1
    assert a.h_align_2 == 1 and a.v_align_1 == 1 and a.h_align_0 == 0
    x = features.unary(cells.select("sheet_id", "r", "c", "v"), "xls", merges.spans(merges.merge_map(areas)), looks, F.lit(False))
    row = x.where("r = 0 and c = 0").first()
    assert row.is_excel == 1 and row.merge_wide == 1 and row.bold == 1
