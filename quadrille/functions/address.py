"""Cell addresses and ranges as Column expressions (indices from 0, A1 rows from 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDRESS = r"^([A-Za-z]+)([0-9]+)$"
_FOUND = r"\b([A-Za-z]+[0-9]+)\b'?(?::'?([A-Za-z]+[0-9]+)\b)?"
BOX = "struct<r0:int,c0:int,r1:int,c1:int>"


def letters(index: Column) -> Column:
    """Column letters of an index: 0 is A, 26 is AA. Up to three letters (18,277); null if negative or beyond."""
    letter = lambda x: F.char(F.lit(65) + x)
    two, three = index - 26, index - 702
    one = letter(index)
    pair = F.concat(letter(F.floor(two / 26)), letter(two % 26))
    triple = F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))
    return F.when(index.between(0, 25), one).when(index.between(26, 701), pair).when(index.between(702, 18277), triple)


def column_index(text: Column) -> Column:
    """Index of column letters in either case; null if other characters occur or there are none."""
    seven = F.lpad(F.upper(text), 7, "@")  # the sign before A, which counts as nothing
    value = sum((F.ascii(F.substr(seven, F.lit(k + 1), F.lit(1))).cast("long") - 64) * 26 ** (6 - k) for k in range(7))
    return F.when(text.rlike("^[A-Za-z]{1,7}$"), value - 1)


def address(row: Column, column: Column) -> Column:
    return F.concat(letters(column), (row + 1).cast("string"))


def format_range(box: Column, single: bool = True) -> Column:
    """A1:B2; a box of one cell as A1, or as A1:A1 where ``single`` is false."""
    first, last = address(box["r0"], box["c0"]), address(box["r1"], box["c1"])
    whole = F.concat_ws(":", first, last)
    return F.when((box["r0"] == box["r1"]) & (box["c0"] == box["c1"]), first).otherwise(whole) if single else whole


def parse_address(text: Column) -> Column:
    """Struct (r, c) of an address, white space at its ends ignored; null if malformed."""
    t = F.trim(text)
    row = F.try_subtract(F.regexp_extract(t, _ADDRESS, 2).try_cast("int"), F.lit(1))
    return F.when(t.rlike(_ADDRESS) & row.isNotNull(), F.struct(row.alias("r"), column_index(F.regexp_extract(t, _ADDRESS, 1)).cast("int").alias("c")))


def parse_range(text: Column, mode: str = "tolerant") -> Column:
    """Struct (r0, c0, r1, c1) of a range.

    tolerant: spaces ignored, one address is a box of one cell, corners are put in order,
    null if malformed. strict: two addresses and a colon, white space only at the ends,
    corners as given, an error if malformed. pair: as strict, but null. sentinel: as pair,
    corners put in order, but -1 in every field if malformed.
    """
    t = F.replace(text, F.lit(" "), F.lit("")) if mode == "tolerant" else F.trim(text)
    box = lambda r0, c0, r1, c1: F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    # each corner is read once, by a lambda's variable, however many fields are taken from it
    cut = F.transform(F.split(t, ":", -1), lambda p: F.struct(F.regexp_extract(p, _ADDRESS, 1).alias("l"), p.alias("p")))
    corners = F.transform(cut, lambda x: F.struct(F.when(x["l"] != "", F.try_subtract(F.substr(x["p"], F.length(x["l"]) + 1).try_cast("int"), F.lit(1))).alias("r"), column_index(x["l"]).cast("int").alias("c"), (x["l"] != "").alias("ok")))

    def of(k: Column) -> Column:
        a, b = F.get(k, F.lit(0)), F.get(k, F.lit(1))
        one = (F.size(k) == 1) & a["ok"] & a["r"].isNotNull()
        two = (F.size(k) == 2) & a["ok"] & a["r"].isNotNull() & b["ok"] & b["r"].isNotNull() & t.rlike(r"^\S+$")
        ordered = F.when(two, box(F.least(a["r"], b["r"]), F.least(a["c"], b["c"]), F.greatest(a["r"], b["r"]), F.greatest(a["c"], b["c"])))
        if mode == "tolerant":
            return F.when(one, box(a["r"], a["c"], a["r"], a["c"])).otherwise(ordered)
        return ordered if mode == "sentinel" else F.when(two, box(a["r"], a["c"], b["r"], b["c"]))

    found = F.get(F.transform(F.array(corners), of), F.lit(0))
    if mode == "strict":
        return F.coalesce(found, F.raise_error(F.concat(F.lit("not a range: "), text)).cast(BOX))
    return F.coalesce(found, box(*[F.lit(-1)] * 4)) if mode == "sentinel" else found


def found_ranges(text: Column) -> Column:
    """All ranges and single cells in a model's answer, upper-cased, quotes tolerated: array of A1 or A1:B2."""
    first = F.regexp_extract_all(text, F.lit(_FOUND), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(_FOUND), F.lit(2))
    return F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda m: F.upper(F.when(m["b"] == "", m["a"]).otherwise(F.concat_ws(":", m["a"], m["b"]))))


def corners_merged(text: Column) -> Column:
    """Whether an answer has a range with quotes around its corners."""
    return text.rlike(r"(?i)'[A-Z]+[0-9]+'?:'?[A-Z]+[0-9]+'?")


def no_valid_range(ranges: Column) -> Column:
    """Whether none of the ranges has two corners."""
    return ~F.exists(ranges, lambda r: F.contains(r, F.lit(":")))
