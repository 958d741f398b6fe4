"""Hashes, colours, font sizes and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = "struct<r:int,g:int,b:int>"
#: Named colours, the spreadsheet palette and theme colours.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255),
    "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128),
}
PALETTE = {0: (0, 0, 0), 1: (255, 255, 255), 2: (255, 0, 0), 3: (0, 255, 0), 4: (0, 0, 255), 5: (255, 255, 0), 6: (255, 0, 255), 7: (0, 255, 255)}
BINARY_PALETTE = PALETTE | {8: (0, 0, 0), 9: (255, 255, 255)}
INDEXED = PALETTE | {64: (0, 0, 0), 65: (255, 255, 255)}
AUTOMATIC = (0x40, 0x41, 0x7FFF)
THEME = {
    0: (255, 255, 255), 1: (0, 0, 0), 2: (238, 236, 225), 3: (31, 73, 125), 4: (79, 129, 189),
    5: (192, 80, 77), 6: (155, 187, 89), 7: (128, 100, 162), 8: (75, 172, 198), 9: (247, 150, 70),
}


def _rgb(r, g, b) -> Column:
    part = lambda x, n: (x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n)
    return F.struct(part(r, "r"), part(g, "g"), part(b, "b"))


def _chosen(key: Column, values: dict, otherwise: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, _rgb(*v)) if out is None else out.when(key == k, _rgb(*v))
    return out if otherwise is None else out.otherwise(otherwise)


def stable_hash(s: Column) -> Column:
    """The md5 of a text as a number modulo a million, over a million; 0 for null or the empty text.

    The 128 bits are taken as four parts of 32, each folded in modulo a million.
    """
    digest, value = F.md5(s.cast("binary")), F.lit(0).cast("long")
    for k in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        value = (value * (2**32 % 1_000_000) + part) % 1_000_000
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(0.0)).otherwise(value / 1e6)


def normalised(rgb: Column) -> Column:
    """Parts over 255; zeros for null."""
    part = lambda n: F.coalesce(rgb[n] / 255.0, F.lit(0.0)).alias(n)
    return F.struct(part("r"), part("g"), part("b"))


def hex_colour(s: Column) -> Column:
    """Colours of open-document files: #rgb, #rrggbb, or a name; null for transparent and anything else."""
    t = F.lower(F.trim(s))
    pair = lambda at, n: F.conv(F.substring(t, at, n) if n == 2 else F.repeat(F.substring(t, at, 1), 2), 16, 10)
    six = _rgb(*[pair(at, 2) for at in (2, 4, 6)])
    three = _rgb(*[pair(at, 1) for at in (2, 3, 4)])
    return F.when(t.rlike("^#[0-9a-f]{6}$"), six).when(t.rlike("^#[0-9a-f]{3}$"), three).otherwise(_chosen(t, NAMED))


def palette_colour(index: Column, workbook: Column | None = None) -> Column:
    """Colours of binary workbooks: from the workbook's own map (index to rgb) first; null where automatic."""
    known = _chosen(index, BINARY_PALETTE)
    if workbook is not None:
        known = F.coalesce(F.try_element_at(workbook, index), known)
    return F.when(index.isin(*AUTOMATIC), F.lit(None).cast(RGB)).otherwise(known)


def theme_colour(argb: Column, theme: Column, tint: Column, indexed: Column) -> Column:
    """Colours of xml workbooks: an rgb text (6 or 8 hex digits) decides, then theme with tint, then the indexed palette."""
    six = F.when(F.length(argb) == 8, F.substring(argb, 3, 6)).when(F.length(argb) == 6, argb)
    parsed = F.when(six.rlike("^[0-9A-Fa-f]{6}$"), _rgb(*[F.conv(F.substring(six, at, 2), 16, 10) for at in (1, 3, 5)]))
    base = _chosen(theme, THEME, _rgb(0, 0, 0))
    change = F.coalesce(tint, F.lit(0.0))
    shade = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.when(change < 0, x * (1 + change)).otherwise(x * (1 - change) + 255 * change).cast("int")))
    themed = F.when(theme.isNotNull(), F.when(change == 0, base).otherwise(_rgb(*[shade(base[n]) for n in "rgb"])))
    return F.when(F.coalesce(argb, F.lit("")) != "", parsed).when(theme.isNotNull(), themed).otherwise(_chosen(indexed, INDEXED))


def font_points(s: Column) -> Column:
    """Points of a size with unit pt, px, em, % or none; 0 where it isn't a number."""
    t = F.lower(F.trim(s))
    out = None
    for unit, factor in (("pt", 1.0), ("px", 0.75), ("em", 12.0), ("%", 0.12)):
        test, number = F.endswith(t, F.lit(unit)), F.substring(t, F.lit(1), F.length(t) - len(unit)).try_cast("double") * factor
        out = F.when(test, number) if out is None else out.when(test, number)
    return F.coalesce(out.otherwise(t.try_cast("double")), F.lit(0.0))


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def file_uuid(path: Column) -> Column:
    """The first UUID in a path, or null."""
    found = F.regexp_extract(path, f"(?i){UUID}", 0)
    return F.when(found != "", found)


def annotation_key(labels_path: Column) -> Column:
    """Name of a sheet in results: the annotation's stem without its prefix, as a csv."""
    return F.concat(F.regexp_replace(stem(labels_path), "^annotations_", ""), F.lit(".csv"))


def cache_key(path: Column, sheet: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of path and sheet."""
    return F.substring(F.sha1(F.concat_ws("::", path, F.coalesce(sheet, F.lit(""))).cast("binary")), 1, 16)


def result_id(path: Column, sheet: Column) -> Column:
    """MD5 of path|sheet, by which finished results are known."""
    return F.md5(F.concat_ws("|", path, F.coalesce(sheet, F.lit(""))).cast("binary"))
