"""Sheets in the bytes of csv, xlsx and ods files, with the standard library alone.

A sheet comes as rows of cells (value text, kind, number format, attributes) by place,
and merged areas. Two profiles differ as their users expect: ``classifier`` shows a
merged area's value in all its cells, drops errors, stops at 200 empty rows and reads
ods as text; ``encoder`` keeps covered cells empty and types ods values.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

OLE, ZIP = b"\xd0\xcf\x11\xe0", b"PK"
#: Media types and extensions by format; empty rows at which reading stops; the width of a full-row merge.
MEDIA = {
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel.sheet.macroenabled.12": "xlsx", "application/vnd.ms-excel": "xls",
    "application/vnd.oasis.opendocument.spreadsheet": "ods", "text/csv": "csv", "text/x-csv": "csv", "text/tab-separated-values": "tsv",
}
EXTENSIONS = {"xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "xltm": "xlsx", "xls": "xls", "ods": "ods", "csv": "csv", "tsv": "tsv", "asp": "csv", "aspx": "csv"}
STOP_ROWS, FULL_ROW = 200, 1000
#: Number formats that workbooks refer to by number.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


@dataclass
class Cell:
    v: str | None
    kind: str = "text"
    nf: str = "General"
    attrs: list[str] = field(default_factory=list)
    style: int | None = None


@dataclass
class Sheet:
    name: str | None
    cells: dict[tuple[int, int], Cell]
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    styles: list[dict] = field(default_factory=list)


def sniffed(head: bytes, whole: bytes | None = None) -> str | None:
    """Format by the first bytes; a zip is ods or xlsx by its members."""
    if head[:4] == OLE:
        return "xls"
    if head[:2] == ZIP:
        try:
            with zipfile.ZipFile(io.BytesIO(whole if whole is not None else head)) as z:
                if "mimetype" in z.namelist() and b"opendocument.spreadsheet" in z.read("mimetype"):
                    return "ods"
        except (zipfile.BadZipFile, OSError):
            pass
        return "xlsx"
    return None


def detect_format(path: str, data: bytes, mime: str | None = None, profile: str = "classifier") -> str:
    """classifier: media type, content, extension. encoder: media type and extension by kind of file, content where the extension says nothing."""
    name = path.rsplit("/", 1)[-1]
    ext = EXTENSIONS.get(name.rsplit(".", 1)[1].lower()) if "." in name else None
    media = MEDIA.get((mime or "").split(";")[0].strip().lower())
    content = sniffed(data[:8], data)
    if profile == "classifier":
        found = media or content or ext
    else:
        zipped, plain = data[:2] == ZIP, ext in ("xls", "ods", "csv", "tsv")
        found = "xlsx" if media == "xlsx" or ext == "xlsx" or (zipped and not plain) else "xls" if media == "xls" or ext == "xls" or content == "xls" else media or ext
    if not found:
        raise ValueError(f"unknown format: {path} ({mime})")
    return found


def decoded(data: bytes) -> str:
    """Text of a file: by its mark, else UTF-8, else Latin-1, which takes any bytes."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read_csv(data: bytes, tabs: bool = False, profile: str = "classifier") -> Sheet:
    """All values are text, the empty one null; the classifier profile finds the delimiter, the other takes commas."""
    text = decoded(data)
    delimiter = "\t" if tabs else ","
    if profile == "classifier" and not tabs:
        try:
            delimiter = csv.Sniffer().sniff(text, ",;\t|").delimiter
        except csv.Error:
            pass
    cells = {(r, c): Cell(v) for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) for c, v in enumerate(row) if v != ""}
    return Sheet(None, cells)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _children(e, name: str):
    return [x for x in e if _tag(x) == name] if e is not None else []


def _first(e, name: str):
    return next(iter(_children(e, name)), None)


def place(address: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", address)
    c = 0
    for x in m[1]:
        c = c * 26 + ord(x) - 64
    return int(m[2]) - 1, c - 1


def chosen(names: list[str], wanted: str | int | None) -> int:
    """Index of a sheet: the first by default, by number, or by name; a missing "Sheet1" may be "Sheet 1"."""
    if wanted is None:
        return 0
    if isinstance(wanted, int):
        return wanted
    for name in (wanted, "Sheet 1" if wanted == "Sheet1" else wanted):
        if name in names:
            return names.index(name)
    raise ValueError(f"no sheet {wanted!r} among {names}")


#: Alignments by their place among the features.
H_ALIGN = {"general": 0, "right": 1, "center": 2, "centerContinuous": 2, "justify": 3, "left": 4, "fill": 5, "distributed": 6}
V_ALIGN = {"top": 0, "center": 1, "bottom": 2, "justify": 3, "distributed": 3}
H_CODE, V_CODE = {0: 0, 1: 0, 3: 1, 2: 2, 6: 2, 5: 3, 4: 4, 7: 5}, {0: 0, 1: 1, 2: 2}


def _colour(e, prefix: str) -> dict:
    """What a colour element says: an rgb text, a theme colour with a tint, or an index."""
    get = lambda n, kind: kind(e.get(n)) if e is not None and e.get(n) is not None else None
    return {f"{prefix}_argb": get("rgb", str), f"{prefix}_theme": get("theme", int), f"{prefix}_tint": get("tint", float), f"{prefix}_indexed": get("indexed", int)}


def _styles(z: zipfile.ZipFile) -> list[dict]:
    """Each cell style: number format, attributes, and what its font, fill, borders and alignment are; none where the part is missing or broken."""
    try:
        root = ElementTree.fromstring(z.read("xl/styles.xml"))
    except (KeyError, ElementTree.ParseError):
        return []
    formats = BUILT_IN | {int(x.get("numFmtId")): x.get("formatCode") for x in _children(_first(root, "numFmts"), "numFmt")}
    fonts, fills, borders = [], [], []
    for f in _children(_first(root, "fonts"), "font"):
        on = lambda n: (x := _first(f, n)) is not None and x.get("val", "1") not in ("0", "false", "none")  # noqa: B023, E731
        value = lambda n: x.get("val") if (x := _first(f, n)) is not None else None  # noqa: B023, E731
        fonts.append({"bold": on("b"), "italic": on("i"), "underline": on("u"), "size": float(value("sz") or 11), "font": value("name") or "Calibri"} | _colour(_first(f, "color"), "fg"))
    for f in _children(_first(root, "fills"), "fill"):
        p = _first(f, "patternFill")
        kind = p.get("patternType") if p is not None else None
        fg = _first(p, "fgColor")
        plain = kind in (None, "none") or (kind == "solid" and (fg is None or fg.get("rgb") in ("00000000", "FFFFFFFF")))
        fills.append((not plain, _colour(fg if kind not in (None, "none") else None, "bg")))
    for x in _children(_first(root, "borders"), "border"):
        borders.append({s: _first(x, s) is not None and bool(_first(x, s).get("style")) for s in ("top", "bottom", "left", "right")})
    out = []
    for x in _children(_first(root, "cellXfs"), "xf"):
        at = lambda values, key, other: values[i] if (i := int(x.get(key, 0))) < len(values) else other  # noqa: B023, E731
        font, border, (filled, fill) = at(fonts, "fontId", {}), at(borders, "borderId", {}), at(fills, "fillId", (False, {}))
        attrs = ["FontBold"] * bool(font.get("bold")) + [f"{s.capitalize()}Border" for s in ("top", "bottom", "left", "right") if border.get(s)] + ["FillColor"] * filled
        align = _first(x, "alignment")
        h, v = (align.get("horizontal"), align.get("vertical")) if align is not None else (None, None)
        out.append(font | fill | {f"border_{s}": bool(border.get(s)) for s in ("top", "bottom", "left", "right")} | {"nf": formats.get(int(x.get("numFmtId", 0)), "General"), "attrs": attrs, "h_align": H_ALIGN.get(h, 6) if h else 0, "v_align": V_ALIGN.get(v, 3)})
    return out


def is_date_format(nf: str) -> bool:
    plain = re.sub(r'\[[^\]]*\]|"[^"]*"|\\.', "", nf).lower()
    return nf not in ("General", "@") and bool(re.search("[dyhs]|m{1,5}", plain)) and not re.search("[0#?]e[+-]", plain)


def read_xlsx(data: bytes, sheet: str | int | None = None, profile: str = "classifier") -> Sheet:
    """One sheet by the workbook's order; cached values of formulas; dates as ISO texts; missing styles are plain."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        entries = _children(_first(book, "sheets"), "sheet")
        entry = entries[chosen([e.get("name") for e in entries], sheet)]
        target = rels[next(v for k, v in entry.attrib.items() if k.endswith("}id"))]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _tag(t) == "t"))
        styles = _styles(z)
        props = _first(book, "workbookPr")
        epoch = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        root = ElementTree.fromstring(z.read(part))
    merges = []
    for m in _children(_first(root, "mergeCells"), "mergeCell"):
        a, _, b = m.get("ref").partition(":")
        merges.append((*place(a), *place(b or a)))
    cells: dict[tuple[int, int], Cell] = {}
    r = -1
    for row in _children(_first(root, "sheetData"), "row"):
        r = int(row.get("r")) - 1 if row.get("r") else r + 1
        c = -1
        for x in _children(row, "c"):
            c = place(x.get("r"))[1] if x.get("r") else c + 1
            kind, raw = x.get("t", "n"), _first(x, "v")
            v = raw.text if raw is not None else None
            number = int(x.get("s", 0))
            look = styles[number] if number < len(styles) else {}
            nf, attrs = look.get("nf", "General"), look.get("attrs", [])
            if kind == "s" and v is not None:
                cell = Cell(shared[int(v)], "text", nf, attrs)
            elif kind == "inlineStr":
                cell = Cell("".join(t.text or "" for t in x.iter() if _tag(t) == "t"), "text", nf, attrs)
            elif kind == "b":
                cell = Cell("True" if v == "1" else "False", "bool", nf, attrs)
            elif kind == "e":
                cell = Cell(None if profile == "classifier" else v, "error", nf, attrs)
            elif kind in ("str", "d") or v is None:
                cell = Cell(v, "timestamp" if kind == "d" else "text", nf, attrs)
            elif is_date_format(nf):
                cell = Cell(str(epoch + timedelta(days=float(v))), "timestamp", nf, attrs)
            else:
                whole = re.fullmatch(r"-?\d+", v) is not None
                cell = Cell(v if whole else repr(float(v)), "int" if whole else "float", nf, attrs)
            cell.style = number if number < len(styles) else None
            if cell.v is not None or attrs:
                cells[r, c] = cell
    out = Sheet(entry.get("name"), cells, merges, styles)
    return _as_classifier(out) if profile == "classifier" else out


def _as_classifier(s: Sheet) -> Sheet:
    """Merged areas show their anchor's value; columns beyond the last real one and rows after 200 empty ones go."""
    width = 1 + max([c for _, c in s.cells] + [m[3] for m in s.merges], default=-1)
    if width >= FULL_ROW:
        full = [m for m in s.merges if m[1] == 0 and m[3] + 1 >= FULL_ROW]
        if full:
            rows = {r for m in full for r in range(m[0], m[2] + 1)}
            inner = [c for (r, c), x in s.cells.items() if r not in rows and c < FULL_ROW and x.v is not None]
            width = max(1, 1 + max(inner + [m[3] for m in s.merges if m not in full], default=0))
    cells = {k: x for k, x in s.cells.items() if k[1] < width}
    for r0, c0, r1, c1 in s.merges:
        anchor = s.cells.get((r0, c0))
        for r in range(r0, r1 + 1):
            for c in range(c0, min(c1, width - 1) + 1):
                cells.pop((r, c), None)
                if anchor is not None:
                    cells[r, c] = anchor
    return Sheet(s.name, until_gap(cells), s.merges, s.styles)


def empty(v: str | None) -> bool:
    return v is None or v.strip().lower() in ("", "none", "nan")


def until_gap(cells: dict, limit: int = STOP_ROWS) -> dict:
    """Cells above the first run of ``limit`` rows without content."""
    stop, last = None, -1
    for r in sorted({r for (r, _), x in cells.items() if not empty(x.v)}):
        if r - last - 1 >= limit:
            stop = last + limit
            break
        last = r
    return cells if stop is None else {k: x for k, x in cells.items() if k[0] < stop}


def _ods_text(cell) -> str:
    def whole(e) -> str:
        own = e.text or ""
        for x in e:
            own += {"s": lambda: " " * int(next((v for k, v in x.attrib.items() if k.endswith("}c")), 1)), "tab": lambda: "\t", "line-break": lambda: "\n"}.get(_tag(x), lambda: whole(x))()  # noqa: B023
            own += x.tail or ""
        return own

    return "\n".join(whole(p) for p in _children(cell, "p"))


def _ods_cell(x, get) -> Cell:
    """A typed value: whole floats as ints, percentages and currencies as floats, dates, durations, booleans, texts."""
    kind = get(x, "value-type")
    try:
        if kind == "float":
            number = float(get(x, "value"))
            return Cell(str(int(number)), "int") if number == int(number) else Cell(repr(number), "float")
        if kind in ("percentage", "currency"):
            return Cell(repr(float(get(x, "value"))), "float")
        if kind == "date":
            return Cell(datetime.fromisoformat(get(x, "date-value")[:10]).date().isoformat(), "timestamp")
    except (TypeError, ValueError, OverflowError):
        pass
    if kind == "time" and get(x, "time-value"):
        return Cell(get(x, "time-value"), "text")
    if kind == "boolean" and get(x, "boolean-value"):
        return Cell("True" if get(x, "boolean-value") == "true" else "False", "bool")
    return Cell(_ods_text(x).replace("\n", "") or None)


def read_ods(data: bytes, sheet: str | int | None = None, profile: str = "classifier") -> Sheet:
    """One table. Repeats are spread out where there is content, and only counted where there is none.

    classifier: texts; spanned cells show the anchor's; at most three columns beyond
    content. encoder: typed values; covered cells take no place, so what follows a span
    moves left.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    get = lambda e, n: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == n), None)
    found = [t for t in root.iter() if _tag(t) == "table"]
    table = found[chosen([get(t, "name") for t in found], sheet)]
    cells: dict[tuple[int, int], Cell] = {}
    merges: list[tuple[int, int, int, int]] = []
    r, gap = 0, 0
    for row in (e for e in table.iter() if _tag(e) == "table-row"):
        times, c, content = int(get(row, "number-rows-repeated") or 1), 0, []
        for x in row:
            if _tag(x) not in ("table-cell", "covered-table-cell"):
                continue
            repeat = int(get(x, "number-columns-repeated") or 1)
            if _tag(x) == "covered-table-cell":
                c += repeat if profile == "classifier" else 0
                continue
            cell = Cell(_ods_text(x) or None) if profile == "classifier" else _ods_cell(x, get)
            spans = int(get(x, "number-rows-spanned") or 1), int(get(x, "number-columns-spanned") or 1)
            if cell.v is not None:
                content += [(c + k, cell) for k in range(repeat)]
            if profile == "classifier" and spans != (1, 1):
                merges.append((r, c, r + spans[0] - 1, c + spans[1] - 1))
            c += repeat
        if content:
            for k in range(times):
                cells |= {(r + k, c): x for c, x in content}
            gap = 0
        else:
            gap += times
            if profile == "classifier" and gap >= STOP_ROWS:
                break
        r += times
    if profile == "classifier":
        for r0, c0, r1, c1 in merges:
            if (r0, c0) in cells:
                cells |= {(a, b): cells[r0, c0] for a in range(r0, r1 + 1) for b in range(c0, c1 + 1)}
    return Sheet(get(table, "name"), cells, merges)


def read_xls(data: bytes, sheet: str | int | None = None, profile: str = "classifier") -> Sheet:
    """One sheet of a binary workbook. classifier: whole numbers are ints, dates their serial numbers; encoder: numbers are floats, dates ISO texts, merged areas left out."""
    from . import biff

    whole = biff.stream(data)
    book = biff.book(whole)
    name, at = book.sheets[chosen([n for n, _ in book.sheets], sheet)]
    epoch = datetime(1904, 1, 1) if book.from_1904 else datetime(1899, 12, 30)
    colour = lambda i, prefix: {f"{prefix}_index": i, f"{prefix}_palette": list(book.palette[i]) if i in book.palette else None}
    styles = []
    for x in book.xfs:
        f = book.fonts[x["font"] - (x["font"] > 4)] if x["font"] - (x["font"] > 4) < len(book.fonts) else {"fg": 0x7FFF}
        look = {k: v for k, v in f.items() if k != "fg"} | colour(f["fg"], "fg") | colour(x["bg"] if x["pattern"] else 0x40, "bg")
        look |= dict(zip(("border_left", "border_right", "border_top", "border_bottom"), (b != 0 for b in x["borders"])))
        styles.append(look | {"nf": book.formats.get(x["nf"], BUILT_IN.get(x["nf"], "General")), "attrs": [], "h_align": H_CODE.get(x["h"], 6), "v_align": V_CODE.get(x["v"], 3)})
    cells, merges = {}, []
    for kind, *rest in biff.cells(whole, at, book.strings):
        if kind == "merge":
            merges.append(tuple(rest))
            continue
        r, c, x, v = rest
        nf = styles[x]["nf"] if x < len(styles) else "General"
        if kind == "number" and profile == "encoder" and is_date_format(nf):
            cell = Cell(str(epoch + timedelta(days=v)), "timestamp", nf)
        elif kind == "number":
            cell = Cell(str(int(v)), "int", nf) if v == int(v) and profile == "classifier" else Cell(repr(v), "float", nf)
        else:
            cell = Cell(None if v is None else str(v), kind, nf)
        cell.style = x if x < len(styles) else None
        if cell.v is not None or kind == "error":
            cells[r, c] = cell
    out = Sheet(name, cells, merges if profile == "classifier" else [], styles)
    return _as_classifier(out) if profile == "classifier" else out


def read(path: str, data: bytes, sheet: str | int | None = None, mime: str | None = None, profile: str = "classifier") -> Sheet:
    """A sheet of a file of any format."""
    kind = detect_format(path, data, mime, profile)
    if kind in ("csv", "tsv"):
        return read_csv(data, kind == "tsv" or path.lower().endswith(".tsv"), profile)
    if kind == "xlsx":
        return read_xlsx(data, sheet, profile)
    return read_ods(data, sheet, profile) if kind == "ods" else read_xls(data, sheet, profile)
