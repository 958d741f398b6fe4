"""Repeated word windows: a count-min prefilter, then exact grouping of what it can't rule out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window, and in a gram. A window stands in the sketch for the least of its grams' hashes.
WINDOW, GRAM = 20, 10
#: The sketch: rows, counters in a row as a power of two, slices of a row. Its bits of "twice or more" take 2 * 2**28 / 8 bytes = 64 MB, whatever the input.
ROWS, LOG_WIDTH, SLICES = 2, 28, 64
#: Words worked on at once in a task.
CHUNK = 1 << 20
#: Words that a worker keeps hashed.
KNOWN = 400_000
_PLACE = 28
_U = np.uint64
_LAST = 2**63 - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """A hash of the pair (a, b); order matters."""
    x = (a * _U(m)) ^ ((b << _U(29)) | (b >> _U(35)))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _runs(h: np.ndarray, length: int, m: int) -> np.ndarray:
    """Hash of every run of ``length`` hashes, put together from runs of powers of two."""
    n = len(h) - length + 1
    done, at, power, size = None, 0, h, 1
    while True:
        if length & size:
            part = power[at : at + n]
            done = part if done is None else _mix(done, part, m)
            at += size
        if size * 2 > length:
            return done
        power = _mix(power[:-size], power[size:], m)
        size *= 2


def _least(x: np.ndarray, length: int) -> np.ndarray:
    size = 1
    while size * 2 <= length:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (length - size)], x[length - size :]) if size < length else x


class Chunk:
    """Windows of some documents, put one after another in the order of their keys."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]]):
        docs.sort(key=lambda d: d[:2])
        self.keys = [(k, h) for k, h, _ in docs]
        sizes = np.array([len(w) for _, _, w in docs], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        total = int(self.ends[-1])
        self.hashes = h = np.fromiter((_hashes[w] for _, _, words in docs for w in words), _U, total)
        n = total - WINDOW + 1
        if n < 1:
            self.at = self.doc = np.zeros(0, np.int64)
            self.gram = np.zeros(0, _U)
            return
        grams = _runs(h, GRAM, 0x9E3779B97F4A7C15)
        order = (grams >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(grams), dtype=_U)
        chosen = (_least(order, WINDOW - GRAM + 1) & _U((1 << _PLACE) - 1)).astype(np.int64)
        at = np.arange(n)
        doc = np.repeat(np.arange(len(docs)), sizes)[:n]
        inside = at + WINDOW <= self.ends[doc]
        self.at, self.doc, self.chosen = at[inside], doc[inside], chosen[:n][inside]
        self.gram = grams[self.chosen]

    def sketch(self) -> list[np.ndarray]:
        """Counter numbers by row, one for each chosen place: equal windows choose the same gram at different places."""
        if not len(self.at):
            return [np.zeros(0, np.uint32)] * ROWS
        new = np.concatenate([[True], self.chosen[1:] != self.chosen[:-1]])
        return [_counter(self.gram[new], row) for row in range(ROWS)]


def _counter(gram: np.ndarray, row: int) -> np.ndarray:
    x = (gram ^ (gram >> _U(31))) * _U(0x94D049BB133111EB)
    return ((x >> _U(64 - LOG_WIDTH * (row + 1))) & _U((1 << LOG_WIDTH) - 1)).astype(np.uint32)


def _chunks(batches):
    """Documents of a task as lists of (key, text hash, words), about ``CHUNK`` words each."""
    held, n = [], 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for k, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            words = (t.as_py() or b"").split()
            if len(words) >= WINDOW:
                held.append((k, h, words))
                n += len(words)
                if n >= CHUNK:
                    yield Chunk(held)
                    held, n = [], 0
    if held:
        yield Chunk(held)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each as differences in the fewest bytes, together compressed."""
    parts = []
    for a in arrays:
        d = np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind == "i" else a
        if d.dtype.kind == "i":
            for kind in ("i1", "i2", "i4", "i8"):
                if not d.size or (d.min() >= np.iinfo(kind).min and d.max() <= np.iinfo(kind).max):
                    break
            d = d.astype(kind)
        parts.append(d.dtype.str.encode() + b"," + str(len(d)).encode() + b";" + d.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        comma, semi = data.index(b",", at), data.index(b";", at)
        a = np.frombuffer(data, np.dtype(data[at:comma].decode()), int(data[comma + 1 : semi]), semi + 1)
        out.append(np.cumsum(a.astype(np.int64)) if a.dtype.kind == "i" else a)
        at = semi + 1 + a.nbytes
    return out


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_SKETCH = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
_MARKS = pa.schema([("bucket", pa.int32()), ("k", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("blob", pa.binary())])


def _sketched(batches):
    """Partition sketches: by slice, the counters raised once and those raised twice or more."""
    for chunk in _chunks(batches):
        rows = []
        for row, counters in enumerate(chunk.sketch()):
            which, times = np.unique(counters, return_counts=True)
            per = 1 << (LOG_WIDTH - 6)
            cut = np.searchsorted(which, np.arange(SLICES + 1, dtype=np.int64) * per)
            for s in range(SLICES):
                a, b = cut[s], cut[s + 1]
                if a < b:
                    own, more = which[a:b].astype(np.int64) - s * per, times[a:b] > 1
                    rows.append((row * SLICES + s, len(chunk.at) if not row and not rows else 0, _pack(own[~more]), _pack(own[more])))
        if rows:
            yield _rows(_SKETCH, rows)


def _merged(batches):
    """The sum of each slice's partition sketches, as bits of the counters at two or more."""
    now, counts, n = None, None, 0

    def out():
        return _rows(_SKETCH, [(now, n, np.packbits(counts >= 2, bitorder="little").tobytes(), b"")])

    for batch in batches:
        for s, m, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if s != now:
                if now is not None:
                    yield out()
                now, counts, n = s, np.zeros(1 << (LOG_WIDTH - 6), np.uint8), 0
            n += m
            (a,), (b,) = _unpack(once), _unpack(twice)
            counts[a] = np.minimum(counts[a] + 1, 2)
            counts[b] = 2
    if now is not None:
        yield out()


def _repeated(chunk: Chunk, bits: list[np.ndarray]) -> np.ndarray:
    """Which windows of the chunk the sketch can't rule out: none that occurs twice is missing."""
    some = np.ones(len(chunk.at), bool)
    for row in range(ROWS):
        c = _counter(chunk.gram, row)
        some &= (bits[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return some


def _spans(doc: np.ndarray, at: np.ndarray):
    """Runs of neighbouring places as (doc, first, length)."""
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])]))
    return zip(doc[new].tolist(), at[new].tolist(), np.diff(np.append(new, len(at))).tolist())


def _candidates(batches, sketch, buckets: int):
    """Of every window that may be repeated: a mark if it stands earlier in the same chunk, else an entry for its bucket."""
    bits = sketch.value
    for chunk in _chunks(batches):
        if not len(chunk.at):
            continue
        some = _repeated(chunk, bits)
        if not some.any():
            continue
        at, doc, gram = chunk.at[some], chunk.doc[some], chunk.gram[some]
        one, two = (_runs(chunk.hashes, WINDOW, m)[at] for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        start = at - chunk.begins[doc]
        two = (two >> _U(32)).astype(np.uint32)
        keys = np.array([k for k, _ in chunk.keys], np.int64)
        group = np.lexsort((start, keys[doc], two, one))
        same = np.concatenate([[False], (one[group][1:] == one[group][:-1]) & (two[group][1:] == two[group][:-1])])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(group))))
        head = group[first]
        later = np.zeros(len(at), bool)
        later[group] = (keys[doc[group]] != keys[doc[head]]) | (start[group] != start[head])
        rows = [(chunk.keys[d][0] % buckets, *chunk.keys[d], s, n, None) for d, s, n in _spans(doc[later], start[later])]
        for i in range(0, len(rows), 65536):
            yield _rows(_MARKS, rows[i : i + 65536])
        at, doc, gram, one, two, start = (x[~later] for x in (at, doc, gram, one, two, start))
        bucket = (gram % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)):
            own = order[cut[b] : cut[b + 1]]
            d = doc[own]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            of = [chunk.keys[x] for x in d[new]]
            blob = _pack(np.array([k for k, _ in of], np.int64), np.array([h for _, h in of], np.int64).view(_U), np.diff(np.append(new, len(d))).astype(np.int64), start[own], one[own], two[own])
            rows.append((int(b), None, None, None, None, blob))
        yield _rows(_MARKS, rows)


def _grouped(batches):
    """Marks as they come, and marks of every entry of a bucket that stands earlier elsewhere."""

    def out(blobs):
        parts = [_unpack(x) for x in blobs]
        k = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        h = np.concatenate([np.repeat(p[1], p[2]) for p in parts]).view(np.int64)
        start, one, two = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        group = np.lexsort((start, k, two, one))
        same = np.concatenate([[False], (one[group][1:] == one[group][:-1]) & (two[group][1:] == two[group][:-1])])
        head = group[np.maximum.accumulate(np.where(same, 0, np.arange(len(group))))]
        later = group[(k[group] != k[head]) | (start[group] != start[head])]
        later = later[np.lexsort((start[later], h[later], k[later]))]
        k, h, start = k[later], h[later], start[later]
        if not len(k):
            return
        doc = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
        of = dict(zip(doc.tolist(), zip(k.tolist(), h.tolist())))
        rows = [(None, *of[d], s, n, None) for d, s, n in _spans(doc, start)]
        for i in range(0, len(rows), 65536):
            yield _rows(_MARKS, rows[i : i + 65536])

    now, blobs = None, []
    for batch in batches:
        marks = batch.filter(pc.is_null(batch.column(5)))
        if marks.num_rows:
            yield marks
        held = batch.filter(pc.is_valid(batch.column(5)))
        for b, blob in zip(held.column(0).to_pylist(), held.column(5).to_pylist()):
            if b != now:
                if blobs:
                    yield from out(blobs)
                now, blobs = b, []
            blobs.append(blob)
    if blobs:
        yield from out(blobs)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _stripped(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    for batch in batches:
        rows, size = [], 0
        for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2)):
            words = (text.as_py() or b"").split()
            n = len(words)
            if marks.is_valid and len(marks.values):
                edge = np.zeros(n + 1, np.int32)
                starts, lens = (marks.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + lens + WINDOW - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            rows.append((doc, n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
            size += len(rows[-1][3])
            if size > 32 << 20:
                yield _rows(schema, rows)
                rows, size = [], 0
        yield _rows(schema, rows)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): every text without the words of repeated windows.

    A window is ``WINDOW`` consecutive words of one document (words: runs of anything
    but ASCII white space; null text: none). A word goes if it is in a window whose words
    also start earlier: at a smaller (doc_id, start). Null ids come last; rows that repeat
    an id are told apart by their text, and equal places don't remove each other.

    First pass: each task counts, in a count-min sketch, the least of the 11 gram hashes
    of its windows, once for each place where it is chosen. Equal windows choose equal
    grams at different places, so a window that occurs twice raises its counters twice;
    hence the merged sketch overestimates and loses none. Second pass: windows whose
    counters are all at two or more are grouped exactly, by 96 bits of hash: within a
    chunk first, which leaves one entry of a hot window for each chunk, then in buckets
    of their gram, sized by the number of windows. The sketch's size is fixed, so on
    very large inputs more windows pass it and are grouped; the result is the same.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LAST))).withColumn("h", F.xxhash64("text"))
    scan = rows.select("k", "h", "text")

    sketches = scan.mapInArrow(lambda it: _sketched(it), "slice int, n long, once binary, twice binary")
    merged = sketches.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda it: _merged(it), "slice int, n long, once binary, twice binary")
    bits = [np.zeros((1 << LOG_WIDTH) // 8, np.uint8) for _ in range(ROWS)]
    windows, per = 0, (1 << LOG_WIDTH) // 8 // SLICES
    for r in merged.select("slice", "n", "once").collect():  # 128 slices of half a megabyte at most
        row, s = divmod(r["slice"], SLICES)
        bits[row][s * per : (s + 1) * per] = np.frombuffer(r["once"], np.uint8)
        windows += r["n"]
    sketch = spark.sparkContext.broadcast(bits)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows >> 21)

    marks = "bucket int, k long, h long, start int, len int, blob binary"
    found = scan.mapInArrow(lambda it: _candidates(it, sketch, buckets), marks).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _grouped(it), marks)
    spans = found.groupBy("k", "h").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    return rows.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _stripped(it), _RESULT)

