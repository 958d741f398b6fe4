"""Token-id shards: one array of ids and Elias-Fano document boundaries, written and read by executors."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written
from .eliasfano import EliasFano

#: Head of an index file: magic, bytes of an id, documents, those with a null doc_id.
_HEAD = struct.Struct("<4sB3xQQ")
#: A single space between two characters that aren't white space: no token of a byte-level BPE spans its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces kept in a worker's cache, about 150 MB.
CACHE = 700_000
#: New pieces that the library encodes as one text: few, as a text's words cost more the longer the text is.
LINES = 64
#: Bytes of ids read at once.
READ = 8 << 20


class _Numbers(dict):
    """Piece -> its number; a new piece gets the next one and waits in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Whole texts to ids with the tokenizers library, the ids of each piece between spaces being kept.

    The vocabulary's pattern lets a space stand only at the start of a token, so that a
    single space between non-spaces always starts one; and a single line end between
    non-spaces is a token by itself. A text's ids are hence those of its pieces " x" and
    "\\nx" in a row. Pieces that are empty or have more white space at an end have length
    -1; texts with such a piece are cut where both neighbours of a space aren't white
    space, and these parts encoded. New pieces are encoded many at a time, one on a line.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.begins, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, self.kind)
        self.filled = 0

    def _keep(self, number: int, data: list[bytes | None]) -> None:
        """Ids of the pieces from ``number`` on; arrays double when they are full."""
        sizes = np.array([-1 if d is None else len(d) // self.kind.itemsize for d in data], np.int32)
        ids = np.frombuffer(b"".join(d for d in data if d), self.kind)
        while number + len(data) > len(self.sizes):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        held = np.maximum(sizes, 0)
        self.sizes[number : number + len(data)] = sizes
        self.begins[number : number + len(data)] = self.filled + np.cumsum(held) - held
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, none of which has a line end, from one text with a part on each line."""
        out: list[bytes] = []
        for at in range(0, len(parts), LINES):
            some = parts[at : at + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.line).tolist()
            if len(cut) != len(some) - 1:
                out += self._batch(some)
                continue
            data, wide = ids.tobytes(), self.kind.itemsize
            out += [data[a * wide : b * wide] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(ids)])]
        return out

    def _learn(self, first: int, new: list[str]) -> None:
        edges_ok = lambda x: x and not x[0].isspace() and not x[-1].isspace()
        line = np.array([self.line], self.kind).tobytes()
        data: list[bytes | None] = [None] * len(new)
        spaced = [i for i, p in enumerate(new) if p[:1] != "\n" and edges_ok(p)]
        for i, x in zip(spaced, self._lines([" " + new[i] for i in spaced])):
            data[i] = x
        lined = [i for i, p in enumerate(new) if p[:1] == "\n" and edges_ok(p[1:])]
        for i, x in zip(lined, self._lines([new[i][1:] for i in lined])):
            data[i] = line + x
        self._keep(first, data)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``kind``."""
        if len(self.numbers) > CACHE:
            self._clear()
        first = len(self.numbers)
        get = self.numbers.__getitem__
        pieces = [np.array(list(map(get, ("\n" + t).replace("\n", " \n").split(" ")[1:])), np.int64) for t in texts]
        if self.numbers.new:
            self._learn(first, self.numbers.new)
            self.numbers.new = []
        out = []
        for text, parts in zip(texts, pieces):
            sizes = self.sizes[parts]
            if sizes.min() < 0:
                cut = _CUT.split(text)
                out.append(b"".join(self._batch([cut[0]] + [" " + c for c in cut[1:]])))
                continue
            ends = np.cumsum(sizes)
            at = np.repeat(self.begins[parts] - ends + sizes, sizes) + np.arange(ends[-1])
            out.append(self.ids[at[1:]].tobytes())  # without the line end put before the text
        return out


@lru_cache(2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _place(path: str):
    """A file system of pyarrow for a URI or a path, and the path in it. Hadoop's older names of S3 mean the same store."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _write_index(files, where: str, wide: int, sizes: list[int], ids: list[int], nulls: int) -> int:
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    least = ids[0] if ids else 0
    with files.open_output_stream(where) as f:
        f.write(_HEAD.pack(b"QTK1", wide, len(sizes), nulls) + struct.pack("<q", least))
        f.write(EliasFano.of(bounds).to_bytes())
        f.write(EliasFano.of(np.array([d - least for d in ids], np.uint64)).to_bytes())
    return int(bounds[-1])


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text (null: empty) and writes ids in ascending doc_id order; returns the manifest.

    Rows are dealt by ranges of doc_id (nulls first; equal ids by a hash of their text,
    equal texts as they come, so that no id is one task's alone) and sorted, then
    each task streams its ids to ``<part>-<attempt>.ids`` and its boundaries and doc_ids,
    both Elias-Fano lists, to ``.idx``. The manifest row (part, file, n_docs, n_ids) is
    written by Spark's own committer: files of lost or doubled attempts are in no row
    of it and never read. Memory is that of a batch and of the shard's lengths. An
    empty table gives an empty manifest. ``path`` must be on a file system that pyarrow
    knows: local, hdfs, s3 or gs.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        enc = _encoder(vocabulary)
        end = np.array([end_id], enc.kind).tobytes()
        files, where = _place(path)
        files.create_dir(where, recursive=True)
        sink, ids, sizes, nulls = None, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sink = sink or files.open_output_stream(f"{where}/{name}.ids")
                for doc, data in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    sink.write(data + end)
                    sizes.append((len(data) + len(end)) // enc.kind.itemsize)
                    if doc is None:
                        nulls += 1
                    else:
                        ids.append(doc)
        if not sizes:
            return
        sink.close()
        total = _write_index(files, f"{where}/{name}.idx", enc.kind.itemsize, sizes, ids, nulls)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(sizes)], pa.int64()), pa.array([total], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "h", "at").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")
    return written(rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "manifest")[0]


class Shard:
    """One shard: documents by place, their ids and where they begin."""

    def __init__(self, path: str, file: str):
        files, where = _place(path)
        with files.open_input_file(f"{where}/{file}.idx") as f:
            data = f.read()
        magic, wide, self.n_docs, self.nulls = _HEAD.unpack_from(data)
        if magic != b"QTK1":
            raise ValueError("not a token index")
        (self.least,) = struct.unpack_from("<q", data, _HEAD.size)
        self.bounds, at = EliasFano.from_bytes(data, _HEAD.size + 8)
        self.docs, _ = EliasFano.from_bytes(data, at)
        self.kind = np.dtype(f"<u{wide}")
        self._files, self._ids = files, f"{where}/{file}.ids"

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects and one read."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        with self._files.open_input_file(self._ids) as f:
            return np.frombuffer(f.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs.select(i - self.nulls)

    def scan(self):
        """(doc_id, begin, ids) of every document; the file is read in steps of ``READ`` bytes, a longer document whole."""
        with self._files.open_input_file(self._ids) as f:
            i = 0
            while i < self.n_docs:
                bounds = self.bounds.values(i, i + 4097).astype(np.int64)
                n = max(1, min(len(bounds) - 1, int(np.searchsorted(bounds, bounds[0] + READ // self.kind.itemsize, "right")) - 1))
                data = np.frombuffer(f.read_at(int(bounds[n] - bounds[0]) * self.kind.itemsize, int(bounds[0]) * self.kind.itemsize), self.kind)
                a = max(0, i - self.nulls)
                known = iter((self.docs.values(a, max(0, i + n - self.nulls)).astype(np.int64) + self.least).tolist())
                for k in range(n):
                    yield None if i + k < self.nulls else next(known), int(bounds[k]), data[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]]
                i += n


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    The manifest has one row a shard; from their counts the driver sums where each
    shard starts. Each shard is one task's.
    """
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        shards.append((r.file, start))
        start += r.n_ids

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for doc, begin, ids in Shard(path, file).scan():
                    out.append((doc, base + begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 8192:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    todo = spark.createDataFrame(shards, "file string, base long").repartition(max(1, len(shards)))
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards to the shared folder and returns what reading them back gives."""
    path = new_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, vocabulary, end_id))
