"""The 67 features of a cell and the 30 of two neighbours, from arrays of some whole sheets at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.style import normalised, palette_colour, stable_hash, theme_colour
from .kernels import ROWS, numbers, per_batch

#: Names of the features by their place.
CONTENT = ("is_na", "is_number", "is_string", "is_date", "is_formula", "length", "digits", "letters", "spaces", "others", "is_int", "is_float", "starts_letter", "starts_numeral", "row_place", "col_place", "on_border", "row_filled", "col_filled", "neighbours", "isolated", "is_ods", "is_excel")
FORMAT = ("bold", "italic", "underline", "font_size", "font_hash", "fg_r", "fg_g", "fg_b", "bg_r", "bg_g", "bg_b", "in_merge", "border_left", "border_right", "border_top", "border_bottom", *[f"h_align_{i}" for i in range(7)], *[f"v_align_{i}" for i in range(6)])
CONTEXT = ("row_share", "row_numbers", "row_strings", "row_alike", "row_uniform", "row_alone", "col_share", "col_numbers", "col_strings", "col_alike", "col_alone", "col_outlier", "merge_cols", "merge_rows", "merge_wide")
UNARY = (*CONTENT, *FORMAT, *CONTEXT)
#: Features left out of the smaller selection, by place.
DROPPED = (17, 18, 20, *range(52, 67))
#: Kinds of cells by the number that kernels get; numbers, strings, dates and formulas; texts' statistics.
KINDS = ("empty", "int", "float", "string", "bool", "date", "formula")
GROUPS = {"num": (1, 2), "str": (3, 4), "dat": (5,), "for": (6,)}
STATS = ("length", "digits", "letters", "spaces", "others", "starts_letter", "starts_numeral")
PAIR = (
    "same_row", "same_col", "is_after", "both_na", "both_number", "both_string", "both_date", "both_formula", "d_length", "d_digits", "d_letter",
    "one_na", "number_string", "number_date", "same_font", "same_size", "both_bold", "both_italic", "same_fg", "d_fg_r", "d_fg_g", "d_fg_b",
    "same_bg", "d_bg_r", "d_bg_g", "d_bg_b", "border", "h_differs", "v_differs", "both_underlined",
)


def default_format(size: float = 10.0, font: str = "Arial") -> dict[str, Column]:
    """Not bold, black on nothing, first alignments."""
    out = {name: F.lit(0.0) for name in FORMAT}
    return out | {"font_size": F.lit(size), "font_hash": stable_hash(F.lit(font)), "bg_r": F.lit(-1.0), "bg_g": F.lit(-1.0), "bg_b": F.lit(-1.0), "h_align_0": F.lit(1.0), "v_align_3": F.lit(1.0)}


def formats(cells: DataFrame, styles: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(sheet_id, r, c, and ``FORMAT``) of cells (sheet_id, r, c, style) whose style (sheet_id, style, fields of a workbook's style) is known.

    merged: cell to anchor (sheet_id, r, c, ar, ac): covered cells look like their anchor
    and count as in a merged area.
    """
    x = cells.select("sheet_id", "r", "c", "style")
    if merged is not None:
        anchor = x.select("sheet_id", F.col("r").alias("ar"), F.col("c").alias("ac"), F.col("style").alias("_style"))
        inside = merged.join(anchor, ["sheet_id", "ar", "ac"], "left").select("sheet_id", "r", "c", F.col("_style").alias("style"), F.lit(True).alias("_in"))
        x = x.join(merged, ["sheet_id", "r", "c"], "left_anti").withColumn("_in", F.lit(False)).unionByName(inside)
    else:
        x = x.withColumn("_in", F.lit(False))
    x = x.join(styles, ["sheet_id", "style"])

    def colour(p: str) -> Column:
        own = F.when(F.size(f"{p}_palette") == 3, F.struct(F.get(f"{p}_palette", F.lit(0)).alias("r"), F.get(f"{p}_palette", F.lit(1)).alias("g"), F.get(f"{p}_palette", F.lit(2)).alias("b")))
        by_index = F.when(palette_colour(F.col(f"{p}_index")).isNull() & F.col(f"{p}_index").isin(0x40, 0x41, 0x7FFF), F.lit(None)).otherwise(F.coalesce(own, palette_colour(F.col(f"{p}_index"))))
        return F.coalesce(theme_colour(F.col(f"{p}_argb"), F.col(f"{p}_theme"), F.col(f"{p}_tint"), F.col(f"{p}_indexed")), by_index)

    fg, bg = normalised(colour("fg")), colour("bg")
    values = {"font_size": F.coalesce("size", F.lit(11.0)), "font_hash": stable_hash(F.coalesce("font", F.lit("Calibri"))), "in_merge": _flag(F.col("_in"))}
    values |= {n: _flag(F.col(n)) for n in ("bold", "italic", "underline", "border_left", "border_right", "border_top", "border_bottom")}
    values |= {f"fg_{n}": fg[n] for n in "rgb"} | {f"bg_{n}": F.when(bg.isNull(), -1.0).otherwise(bg[n] / 255.0) for n in "rgb"}
    values |= {f"h_align_{i}": (F.coalesce("h_align", F.lit(0)) == i).cast("double") for i in range(7)} | {f"v_align_{i}": (F.coalesce("v_align", F.lit(3)) == i).cast("double") for i in range(6)}
    return x.select("sheet_id", "r", "c", *[values[n].cast("double").alias(n) for n in FORMAT])


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


def _described(v: Column, stats: list[str], kind: Column | None = None, date: Column | None = None) -> Column:
    """Struct of a cell's kind, by its place in ``KINDS``, and the statistics of its text."""
    na = T.is_empty_for_features(v)
    number = F.when(na, 0).otherwise(F.array_position(F.array(*map(F.lit, KINDS)), T.cell_type(v, kind, date)) - 1).cast("tinyint")
    of = {n: T.text_stats(v)[n] for n in STATS[:5]} | {"length": F.length(v), "starts_letter": T.starts_with_letter(v), "starts_numeral": T.starts_with_numeral(v)}
    return F.struct(number.alias("kind"), *[F.when(na, 0).otherwise(of[n].cast("int")).alias(n) for n in stats])


def _grids(wanted: list[str], file_format: str, strips: bool = True) -> Callable:
    """A kernel from described cells to ``wanted`` features of every place of their sheets, as many sheets, or rows of a large one, at a time as have ``ROWS`` places."""

    def part(ids, s, r, c, x, h, w, top, rows) -> list:
        """Features of ``rows`` rows of each sheet from row ``top`` on; s: the sheets of cells, h and w: sheets' sizes."""
        base, above, left = (np.cumsum(k) - k for k in (rows * w, rows, w))
        total = int((rows * w).sum())
        sheet = np.repeat(np.arange(len(ids)), rows * w)
        row, col = np.divmod(np.arange(total) - base[sheet], w[sheet])
        here = (r >= top) & (r < top + rows[s])
        at = (base[s] + (r - top) * w[s] + c)[here]
        known: dict = {}

        def placed(n: str) -> np.ndarray:
            out = np.zeros(total, np.int64)
            out[at] = x[n][here]
            return out

        def once(key, make):
            if key not in known:
                known[key] = make()
            return known[key]

        kind = placed("kind")
        full = x["kind"] > 0
        is_ = lambda *kinds: np.isin(kind, kinds)

        def count(axis: str, group: str | None = None) -> np.ndarray:
            def make():
                mask = full if group is None else np.isin(x["kind"], GROUPS[group])
                if axis == "c":
                    return np.bincount((left[s] + c)[mask], minlength=int(w.sum()))[left[sheet] + col]
                return np.bincount((above[s] + r - top)[mask & here], minlength=int(rows.sum()))[above[sheet] + row]

            return once((axis, group), make)

        def near() -> np.ndarray:
            out = np.zeros(total, np.int64)
            for dr, dc in ((0, -1), (0, 1), (-1, 0), (1, 0)):
                r2, c2 = r + dr, c + dc
                ok = full & (r2 >= top) & (r2 < top + rows[s]) & (c2 >= 0) & (c2 < w[s])
                out += np.bincount((base[s] + (r2 - top) * w[s] + c2)[ok], minlength=total)
            return out

        most = lambda p: once(("most", p), lambda: np.max([count(p, g) for g in GROUPS], axis=0))
        share = lambda p, g: count(p, g) / np.maximum(count(p), 1)
        beside = lambda: once("near", near)
        height, width, place = h[sheet], w[sheet], row + top

        def outlier() -> np.ndarray:
            best = np.select([count("c", g) == most("c") for g in ("num", "str", "dat")], [0, 1, 2], 3)
            return (kind > 0) & (np.array([-1, 0, 0, 1, 1, 2, 3])[kind] != best) & (count("c") > 1)

        values = {
            "is_na": lambda: kind == 0, "is_number": lambda: is_(1, 2), "is_string": lambda: is_(3, 4), "is_date": lambda: is_(5), "is_formula": lambda: is_(6),
            **{n: (lambda n=n: placed(n)) for n in STATS}, "is_int": lambda: is_(1), "is_float": lambda: is_(2),
            "row_place": lambda: place / height, "col_place": lambda: col / width, "on_border": lambda: (place == 0) | (col == 0) | (place == height - 1) | (col == width - 1),
            "row_filled": lambda: count("r") / width, "col_filled": lambda: count("c") / height, "neighbours": beside, "isolated": lambda: beside() == 0,
            "is_ods": lambda: np.full(total, file_format == "ods"), "is_excel": lambda: np.full(total, file_format.startswith("xls")),
            "row_share": lambda: count("r") / width, "row_numbers": lambda: share("r", "num"), "row_strings": lambda: share("r", "str"), "row_alike": lambda: most("r") / np.maximum(count("r"), 1),
            "row_uniform": lambda: (count("r") > 0) & (most("r") == count("r")), "row_alone": lambda: count("r") == 1,
            "col_share": lambda: count("c") / height, "col_numbers": lambda: share("c", "num"), "col_strings": lambda: share("c", "str"), "col_alike": lambda: most("c") / np.maximum(count("c"), 1),
            "col_alone": lambda: count("c") == 1, "col_outlier": outlier, "_h": lambda: height, "_w": lambda: width,
        }
        return [ids[sheet], place, col, *[np.asarray(values[n](), np.float64) for n in wanted]]

    def kernel(ids: np.ndarray, cuts: np.ndarray, given: dict) -> Iterator[list]:
        r, c = numbers(given["r"]).astype(np.int64), numbers(given["c"]).astype(np.int64)
        x = {n: numbers(a) for n, a in given.items() if n not in ("r", "c")}
        s = np.repeat(np.arange(len(ids)), np.diff(cuts))
        h, w = (np.maximum.reduceat(k, cuts[:-1]) + 1 for k in (r, c))
        places = np.cumsum(h * w)
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(places, (places[at - 1] if at else 0) + ROWS, "right")))
            own = slice(cuts[at], cuts[end])
            some = (ids[at:end], s[own] - at, r[own], c[own], {n: a[own] for n, a in x.items()}, h[at:end], w[at:end])
            step = max(1, ROWS // int(w[at])) if strips and end == at + 1 else int(h[at])
            if step >= h[at]:
                yield part(*some, 0, h[at:end])
            else:
                for top in range(0, int(h[at]), step):
                    yield part(*some, top, np.array([min(step, int(h[at]) - top)]))
            at = end

    return kernel


def _cells(cells: DataFrame, stats: list[str], kind: str | None, date: Column | None) -> DataFrame:
    """Described cells; those in rows (see ``per_batch``) stay in rows where no parser of Python's is asked for dates."""
    if "c" not in cells.columns and date is not None:
        return cells.select("sheet_id", "r", F.transform("v", lambda v: _described(v, stats, None, date)).alias("cell"))
    if "c" not in cells.columns:
        cells = cells.select("sheet_id", "r", F.posexplode("v").alias("c", "v"))
    x = cells.where("r >= 0 and c >= 0").select("sheet_id", "r", "c", _described(F.col("v"), stats, F.col(kind) if kind else None, date).alias("_cell"))
    return x.select("sheet_id", "r", "c", "_cell.*")


def unary(cells: DataFrame, file_format: str = "csv", merges: DataFrame | None = None, formats: DataFrame | None = None, date: Column | None = None, kind: str | None = None, only: tuple[str, ...] = UNARY) -> DataFrame:
    """(sheet_id, r, c, and ``only``, by default ``UNARY``) for every place of each sheet.

    merges: spans (sheet_id, r, c, row_span, col_span); formats: ``FORMAT`` columns by
    place, defaults elsewhere. date: what counts as a date, by default ``is_date``.
    Only cells are dealt by sheet; places are made in kernels, so the grid is never sorted
    or dealt, unless merges or formats are joined to it.
    """
    made = [n for n in (*CONTENT, *CONTEXT) if n in only and not n.startswith("merge_")] + ["_h", "_w"]
    stats = [n for n in STATS if n in made]
    schema = "sheet_id long, r int, c int, " + ", ".join(f"{n} double" for n in made)
    x = per_batch(_cells(cells, stats, kind, date), ["r", "c", "kind", *stats], _grids(made, file_format), schema)
    if merges is not None:
        x = x.join(merges, ["sheet_id", "r", "c"], "left")
    span = lambda n: F.coalesce(n, F.lit(1)) if merges is not None else F.lit(1)
    values = {n: F.col(n) for n in made} | {"merge_cols": span("col_span") / F.col("_w"), "merge_rows": span("row_span") / F.col("_h"), "merge_wide": _flag(span("col_span") >= 3)}
    defaults = default_format()
    if formats is not None:
        x = x.join(formats, ["sheet_id", "r", "c"], "left")
        defaults = {n: F.coalesce(F.col(n), d) if n in formats.columns else d for n, d in defaults.items()}
    values |= defaults
    return x.select("sheet_id", "r", "c", *[values[n].cast("double").alias(n) for n in only])


def selected(features: DataFrame) -> DataFrame:
    """Without the features of ``DROPPED``: 49 columns."""
    return features.select("sheet_id", "r", "c", *[n for i, n in enumerate(UNARY) if i not in DROPPED])


def _fields(name: str, compatible: bool = True) -> tuple[str, ...]:
    """What a feature of two neighbours is made of."""
    colours = {f"{k}_{p}": tuple(f"{p}_{n}" for n in "rgb") for k in ("same",) for p in ("fg", "bg")}
    pairs = {"number_string": ("is_number", "is_string"), "number_date": ("is_number", "is_date"), "one_na": ("is_na",), "both_underlined": ("in_merge",) if compatible else ("underline",), "same_font": ("font_hash",), "same_size": ("font_size",), "d_digits": ("digits",), "d_letter": ("starts_letter",), "d_length": ("length",), "border": ("border_right", "border_left", "border_top", "border_bottom"), "h_differs": tuple(f"h_align_{k}" for k in range(7)), "v_differs": tuple(f"v_align_{k}" for k in range(6)), "both_bold": ("bold",), "both_italic": ("italic",)}
    if name in ("same_row", "same_col", "is_after"):
        return ()
    return (colours | pairs).get(name) or ((name[2:],) if name.startswith("d_") else ("is_" + name[5:],))


def _pairs(only: tuple[str, ...], compatible: bool) -> Callable:
    """A kernel from features of the places of some sheets to those of two neighbours."""

    def kernel(ids: np.ndarray, cuts: np.ndarray, x: dict) -> Iterator[list]:
        sheet = np.repeat(np.arange(len(ids)), np.diff(cuts))
        r, c = numbers(x["r"]), numbers(x["c"])
        across = np.flatnonzero((sheet[1:] == sheet[:-1]) & (r[1:] == r[:-1]))
        order = np.lexsort((r, c, sheet))
        down = np.flatnonzero((sheet[order][1:] == sheet[order][:-1]) & (c[order][1:] == c[order][:-1]))
        i, j = np.concatenate([across, order[down]]), np.concatenate([across + 1, order[down + 1]])
        right = np.arange(len(i)) < len(across)

        def value(name: str) -> np.ndarray:
            a, b = ([numbers(x[n])[k] for n in _fields(name, compatible)] for k in (i, j))
            if name in ("same_row", "same_col"):
                return right if name == "same_row" else ~right
            if name == "is_after":
                return right if compatible else np.ones(len(i))
            if name == "one_na":
                return (a[0] > 0.5) != (b[0] > 0.5)
            if name in ("number_string", "number_date"):
                return ((a[0] > 0.5) & (b[1] > 0.5)) | ((b[0] > 0.5) & (a[1] > 0.5))
            if name == "border":
                return np.where(right, (a[0] == 1) | (b[1] == 1), (b[2] == 1) | (a[3] == 1))
            if name in ("h_differs", "v_differs"):
                return np.argmax(a, axis=0) != np.argmax(b, axis=0)
            if name.startswith("both_"):
                return (a[0] > 0.5) & (b[0] > 0.5)
            if name.startswith("d_"):
                return np.abs(a[0] - b[0])
            return np.all([p == q for p, q in zip(a, b)], axis=0)

        yield [ids[sheet[i]], r[i], c[i], r[j], c[j], *[np.asarray(value(n), np.float64) for n in only]]

    return kernel


def _pair_schema(only: tuple[str, ...]) -> str:
    return "sheet_id long, r int, c int, r2 int, c2 int, " + ", ".join(f"{n} double" for n in only)


def pairwise(features: DataFrame, compatible: bool = True, only: tuple[str, ...] = PAIR) -> DataFrame:
    """(sheet_id, r, c, r2, c2, and ``only``, by default ``PAIR``) for each place and its right, then its lower neighbour.

    compatible: the last feature reads whether both cells are in a merged area, and a
    lower neighbour never counts as after, as models trained on this layout expect;
    otherwise both follow their names.
    """
    fields = list(dict.fromkeys(f for n in only for f in _fields(n, compatible)))
    return per_batch(features, ["r", "c", *fields], _pairs(only, compatible), _pair_schema(only))


def neighbours(cells: DataFrame, only: tuple[str, ...], date: Column | None = None, dealt: bool = False) -> DataFrame:
    """``pairwise`` of ``unary``, for features that don't depend on formats, in one kernel: places don't leave it."""
    fields = list(dict.fromkeys(f for n in only for f in _fields(n)))
    stats = [n for n in STATS if n in fields]
    grids, pairs = _grids(fields, "csv", strips=False), _pairs(only, True)

    def kernel(ids: np.ndarray, cuts: np.ndarray, given: dict) -> Iterator[list]:
        for own, r, c, *values in grids(ids, cuts, given):
            new = np.append(True, own[1:] != own[:-1])
            ends = np.append(np.flatnonzero(new), len(own))
            yield from pairs(own[new], ends, {n: pa.array(a) for n, a in zip(["r", "c", *fields], [r, c, *values])})

    return per_batch(_cells(cells, stats, None, date), ["r", "c", "kind", *stats], kernel, _pair_schema(only), dealt)
