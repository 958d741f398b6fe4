"""Binary workbooks: streams of a compound file, and the records of their sheets (version 8)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE
#: Record numbers.
BOF, EOF, CONTINUE, FILEPASS = 0x809, 0x0A, 0x3C, 0x2F
BOUNDSHEET, SST, FONT, FORMAT, XF, PALETTE, DATEMODE = 0x85, 0xFC, 0x31, 0x41E, 0xE0, 0x92, 0x22
BLANK, MULBLANK, NUMBER, RK, MULRK, LABELSST, LABEL, RSTRING, BOOLERR, FORMULA, STRING, MERGED = 0x201, 0xBE, 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0xD6, 0x205, 0x06, 0x207, 0xE5


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A stream of a compound file by name: sectors are chained through the allocation table, small streams through a second one."""
    size = 1 << struct.unpack_from("<H", data, 0x1E)[0]
    small = 1 << struct.unpack_from("<H", data, 0x20)[0]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", data, 0x30)[0], struct.unpack_from("<I", data, 0x38)[0], struct.unpack_from("<I", data, 0x3C)[0]
    more, = struct.unpack_from("<I", data, 0x44)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    tables = [x for x in struct.unpack_from("<109I", data, 0x4C) if x < _END]
    while more < _END:
        entries = struct.unpack(f"<{size // 4}I", sector(more))
        tables += [x for x in entries[:-1] if x < _END]
        more = entries[-1]
    fat = [x for t in tables for x in struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))]

    def chain(start: int, table: list[int], read) -> bytes:
        parts, seen = [], 0
        while start < _END and start < len(table) and seen <= len(table):
            parts.append(read(start))
            start, seen = table[start], seen + 1
        return b"".join(parts)

    folder = chain(first_dir, fat, sector)
    found, root = {}, None
    for at in range(0, len(folder) - 127, 128):
        n, kind = struct.unpack_from("<HB", folder, at + 64)
        start, length = struct.unpack_from("<II", folder, at + 116)
        if kind == 5:
            root = (start, length)
        elif kind == 2:
            found[folder[at : at + max(0, n - 2)].decode("utf-16-le", "replace")] = (start, length)
    start, length = next(found[n] for n in names if n in found)
    if length >= cutoff or root is None:
        return chain(start, fat, sector)[:length]
    minis = chain(root[0], fat, sector)
    table = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(table) // 4}I", table))
    return chain(start, mini_fat, lambda i: minis[i * small : (i + 1) * small])[:length]


def records(data: bytes, at: int = 0):
    """(number, body, place of each body's parts) with continuations joined, up to the end of the outermost part."""
    depth = 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        parts, at = [data[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(data) and struct.unpack_from("<H", data, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", data, at + 2)[0]
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        if kind == BOF:
            depth += 1
        if depth <= 1:
            yield kind, parts
        if kind == EOF:
            depth -= 1
            if depth <= 0:
                return


class _Parts:
    """Reads through a record and its continuations; a string cut between parts begins again with its width."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, wide_length: bool = True) -> str:
        n = struct.unpack("<H", self.take(2))[0] if wide_length else self.take(1)[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at >= len(self.parts[self.part]):
                if self.part + 1 >= len(self.parts):
                    break
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
            room = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            k = min(n, room)
            out += self.take(k * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= k
            if not k:
                break
        self.take(4 * runs + extra)
        return out


def rk(x: int) -> float:
    """A number packed in 30 bits: a double's head or an integer, perhaps hundredths."""
    value = float(struct.unpack("<i", struct.pack("<I", x))[0] >> 2) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


@dataclass
class Book:
    sheets: list[tuple[str, int]] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    fonts: list[dict] = field(default_factory=list)
    formats: dict[int, str] = field(default_factory=dict)
    xfs: list[dict] = field(default_factory=list)
    palette: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    from_1904: bool = False


def book(data: bytes) -> Book:
    out = Book()
    for kind, parts in records(data):
        body = parts[0]
        if kind == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if kind == BOUNDSHEET and body[5] == 0:
            out.sheets.append((_Parts(parts, 6).text(False), struct.unpack_from("<I", body)[0]))
        elif kind == SST:
            reader = _Parts(parts, 8)
            out.strings = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == FONT:
            height, flags, colour, weight, _, underline = struct.unpack_from("<HHHHHB", body)
            out.fonts.append({"bold": weight >= 700, "italic": bool(flags & 2), "underline": underline != 0, "size": height / 20, "font": _Parts(parts, 14).text(False), "fg": colour})
        elif kind == FORMAT:
            out.formats[struct.unpack_from("<H", body)[0]] = _Parts(parts, 2).text()
        elif kind == XF:
            font, nf, _, align = struct.unpack_from("<HHHB", body)
            border, fill = struct.unpack_from("<II", body, 10)
            out.xfs.append({"font": font, "nf": nf, "h": align & 7, "v": align >> 4 & 7, "borders": [border >> k & 15 for k in (0, 4, 8, 12)], "pattern": fill >> 26, "bg": struct.unpack_from("<H", body, 18)[0] & 127})
        elif kind == PALETTE:
            n = struct.unpack_from("<H", body)[0]
            out.palette = {8 + k: tuple(body[2 + 4 * k : 5 + 4 * k]) for k in range(n)}
        elif kind == DATEMODE:
            out.from_1904 = struct.unpack_from("<H", body)[0] == 1
    return out


def cells(data: bytes, at: int, strings: list[str]):
    """(kind, row, column, style, value) of a sheet's cells; ("merge", r0, c0, r1, c1) of its merged areas."""
    waiting = None
    for kind, parts in records(data, at):
        b = parts[0]
        if kind == STRING and waiting:
            yield "text", *waiting, _Parts(parts).text()
        if kind != STRING:
            waiting = None
        if kind == NUMBER:
            yield "number", *struct.unpack_from("<HHHd", b)
        elif kind == RK:
            r, c, x, v = struct.unpack_from("<HHHI", b)
            yield "number", r, c, x, rk(v)
        elif kind == MULRK:
            r, c = struct.unpack_from("<HH", b)
            for k in range((len(b) - 6) // 6):
                x, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                yield "number", r, c + k, x, rk(v)
        elif kind == LABELSST:
            r, c, x, i = struct.unpack_from("<HHHI", b)
            yield "text", r, c, x, strings[i]
        elif kind in (LABEL, RSTRING):
            yield "text", *struct.unpack_from("<HHH", b), _Parts(parts, 6).text()
        elif kind == BOOLERR:
            r, c, x, v, wrong = struct.unpack_from("<HHHBB", b)
            yield ("error", r, c, x, None) if wrong else ("bool", r, c, x, bool(v))
        elif kind == FORMULA:
            place, result = struct.unpack_from("<HHH", b), b[6:14]
            if result[6:] != b"\xff\xff":
                yield "number", *place, struct.unpack("<d", result)[0]
            elif result[0] == 0:
                waiting = place
            elif result[0] == 1:
                yield "bool", *place, bool(result[2])
            else:
                yield "error" if result[0] == 2 else "blank", *place, None
        elif kind == BLANK:
            yield "blank", *struct.unpack_from("<HHH", b), None
        elif kind == MULBLANK:
            r, c = struct.unpack_from("<HH", b)
            for k in range((len(b) - 6) // 2):
                yield "blank", r, c + k, struct.unpack_from("<H", b, 4 + 2 * k)[0], None
        elif kind == MERGED:
            for k in range(struct.unpack_from("<H", b)[0]):
                r0, r1, c0, c1 = struct.unpack_from("<HHHH", b, 2 + 8 * k)
                yield "merge", r0, c0, r1, c1
