"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, their patterns, and the least length of what counts (of group 2 for assign).
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: What the models judge: identifier-like runs of this length at least, and what the fixed patterns leave of them, that hold a letter.
LEAST_RUN = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: What counts as an identifier of ordinary text: such runs of this length at least.
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: A piece with fewer transitions counts as one of so many, the others neutral: a few characters alone are weak evidence.
LEAST_TRANSITIONS = 9

#: Characters of the models: a-z, A-Z, 0-9, the six marks, and one class for the edge of a run.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
EDGE = len(_ALPHABET)
SIZE = EDGE + 1
_CODE = np.full(256, EDGE, np.uint8)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(EDGE)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping for each kind, as (kind, start, end) in code points."""
    found: list[Span] = []
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(text: str, span: Span) -> str:
    """The secret itself: group 2 of an assignment, else the whole match."""
    kind, a, b = span
    return _ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]


def transitions(data: bytes) -> np.ndarray:
    """Counts of character pairs; other characters than the alphabet's all count as an edge."""
    codes = _CODE[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.int32)
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


#: Classes of characters: what a random string draws evenly from. The edge is one of its own.
_CLASSES = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-."]
_CLASS = np.array([next(k for k, c in enumerate(_CLASSES) if x in c) for x in _ALPHABET] + [len(_CLASSES)])
#: Counts that stand behind each class of the random model before any labelled value is seen: characters drawn evenly, an edge now and then.
PRIOR, EDGE_RATE = 20.0, 1 / 30
#: The threshold where a corpus has fewer than ``LEAST_LABELLED`` labelled values to calibrate it; values are as short as ``LEAST_RUN``.
THRESHOLD, LEAST_LABELLED = 1.25, 20


class Models:
    """Two first-order chains and the threshold of the mean log-likelihood ratio.

    The ordinary chain has a probability for each pair of characters. The random one has
    few examples, so its pairs share what their classes have in common: the probability
    of the next character's class after this one's, and any character of it alike. A
    corpus may label one kind of secret only, so the same chain as it is before learning
    stands beside it, and a run counts by the likelier of both.
    """

    def __init__(self, ordinary: np.ndarray, random: np.ndarray, threshold: float = THRESHOLD):
        self.ratio = np.stack([self._tied(random), self._tied(np.zeros(SIZE * SIZE))]) - self._logs(ordinary, 0.5)
        self.threshold = threshold

    @staticmethod
    def _logs(counts: np.ndarray, alpha: float) -> np.ndarray:
        c = counts.reshape(SIZE, SIZE).astype(float) + alpha
        return np.log(c / c.sum(1, keepdims=True))

    @staticmethod
    def _tied(counts: np.ndarray) -> np.ndarray:
        n = len(_CLASSES) + 1
        size = np.bincount(_CLASS, minlength=n).astype(float)
        even = np.append(size[:-1] / size[:-1].sum() * (1 - EDGE_RATE), EDGE_RATE)
        c = np.zeros((n, n))
        np.add.at(c, (_CLASS[:, None], _CLASS[None, :]), counts.reshape(SIZE, SIZE).astype(float))
        c += PRIOR * even
        return np.log(c / c.sum(1, keepdims=True) / size)[_CLASS][:, _CLASS]

    def ratios(self, run: str) -> np.ndarray:
        """Log-likelihood ratios of each of the run's transitions, from its edge to its edge, either random chain over ordinary."""
        codes = _CODE[np.frombuffer(b" " + run.encode("latin-1", "replace") + b" ", np.uint8)]
        return self.ratio[:, codes[:-1], codes[1:]]

    def score(self, run: str) -> float:
        """Mean log-likelihood ratio of the run's transitions, random over ordinary."""
        return float(self.ratios(run).mean(1).max())

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Runs that look random, and of runs that touch spans of the fixed patterns each piece beside these that does."""
        found = []
        for m in _RUN.finditer(text):
            run, (a, b) = m[0], m.span()
            pieces, at = [], a
            for x, y in sorted((x, y) for _, x, y in base if a < y and x < b):
                if x > at:
                    pieces.append((at, x))
                at = max(at, y)
            if at < b:
                pieces.append((at, b))
            pieces = [(x, y) for x, y in pieces if any(c.isalpha() for c in text[x:y])]
            if not pieces:
                continue
            ratios = self.ratios(run)
            for x, y in pieces:
                own = ratios[:, x - a : y - a + 1]
                if own.sum(1).max() > self.threshold * max(own.shape[1], LEAST_TRANSITIONS):
                    found.append(("markov", x, y))
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans put together where they overlap, so that no character counts twice."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def samples(text: str) -> tuple[list[str], list[str]]:
    """What a text teaches: identifiers that stand beside all matches of the fixed patterns, and the values that these label."""
    base = base_spans(text)
    values = [(b - len(_value(text, (k, a, b))), b) for k, a, b in base]
    beside, at = [], 0
    for a, b in _merged([(a, b) for _, a, b in base]):
        beside.append(text[at:a])
        at = b
    return _IDENTIFIER.findall(" ".join([*beside, text[at:]])), [text[a:b] for a, b in _merged(values)]


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Sums of a task's transitions: of identifiers, and of the values that the fixed patterns label."""
    ordinary, random = (np.zeros(SIZE * SIZE, np.int64) for _ in range(2))
    for batch in batches:
        for t in batch.column(0).to_pylist():
            for counts, found in zip((ordinary, random), samples(t or "")):
                if found:
                    counts += transitions(" ".join(found).encode())
    cell = np.flatnonzero(ordinary + random)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(ordinary[cell]), pa.array(random[cell])], ["cell", "ordinary", "random"])


#: Width of a bin of scores, and scores beyond which all are alike, for calibration.
_BIN, _FAR = 0.05, 12.0


def _judge(batches, models: Models) -> Iterator[pa.RecordBatch]:
    """How many runs of a task have each score: those beside the fixed patterns, and labelled values, of ``LEAST_RUN`` characters or more."""
    counts = np.zeros((2, int(2 * _FAR / _BIN) + 1), np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            for row, found in zip(counts, samples(t or "")):
                for run in found:
                    if len(run) >= LEAST_RUN:
                        row[int((min(max(models.score(run), -_FAR), _FAR) + _FAR) / _BIN)] += 1
    cell = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(counts[0][cell]), pa.array(counts[1][cell])], ["cell", "ordinary", "random"])


def threshold_of(counts: dict[int, tuple[int, int]]) -> float:
    """The score at which the shares of ordinary runs at or above it and of labelled values below it have the least sum; the middle of the least such scores."""
    n = int(2 * _FAR / _BIN) + 1
    ordinary, random = (np.array([counts.get(k, (0, 0))[i] for k in range(n)], float) for i in (0, 1))
    if random.sum() < LEAST_LABELLED or not ordinary.sum():
        return THRESHOLD
    wrong = (ordinary.sum() - np.cumsum(ordinary) + ordinary) / ordinary.sum() + (np.cumsum(random) - random) / random.sum()
    least = np.flatnonzero(wrong == wrong.min())
    least = least[: np.argmax(np.append(np.diff(least), 2) > 1) + 1]
    return float((least[0] + least[-1]) / 2 * _BIN - _FAR)


def identifier_sample(weight: int = 20) -> np.ndarray:
    """Pair counts of ordinary identifiers: names of the standard library's modules and of their members, in the case styles of code."""
    import importlib

    counts = np.zeros(SIZE * SIZE)
    for module in ("argparse", "collections", "concurrent.futures", "datetime", "email.message", "http.client", "itertools", "logging", "os", "socket", "string", "subprocess", "threading", "unittest", "urllib.parse", "xml.dom.minidom"):
        for name in dir(importlib.import_module(module)):
            plain = name.strip("_")
            parts = [x for x in plain.split("_") if x]
            camel = "".join(x[:1].upper() + x[1:] for x in parts)
            for style in (plain, camel, f"{module}/{plain}2", "-".join(parts) + "-v1", f"{plain}_10"):
                counts += weight / 5 * transitions(style.encode())
    return counts


def train(docs: DataFrame, text_col: str = "text", threshold: float | None = None) -> Models:
    """Models and their threshold from all documents: the fixed patterns label the secrets, identifiers beside them are ordinary.

    Three texts of four, by a hash of the text, are counted: each task sends one row for
    each pair of characters it saw, and the sums, at most ``SIZE`` squared rows whatever
    the input, come to the driver. A sample of the standard library's names stands beside
    the corpus's identifiers. The fourth texts' runs are then scored, and the counts of
    their scores, a few hundred rows, calibrate the threshold (unless one is given). Sums
    don't depend on the order of rows; null and empty texts, and an empty table, add nothing.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    sums = [F.sum(c).alias(c) for c in ("ordinary", "random")]
    schema = "cell int, ordinary long, random long"
    ordinary, random = identifier_sample(), np.zeros(SIZE * SIZE)
    for r in texts.where(~F.col("held")).select("text").mapInArrow(lambda it: _count(it), schema).groupBy("cell").agg(*sums).collect():
        ordinary[r["cell"]] += r["ordinary"]
        random[r["cell"]] += r["random"]
    if threshold is not None:
        return Models(ordinary, random, threshold)
    models = Models(ordinary, random)
    found = texts.where("held").select("text").mapInArrow(lambda it: _judge(it, models), schema).groupBy("cell").agg(*sums).collect()
    models.threshold = threshold_of({r["cell"]: (r["ordinary"], r["random"]) for r in found})
    return models


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans): array of (kind, start, end) over each whole text, by start, then kind; one row for each row.

    Null texts count as empty and have no spans. Places are code points, ends exclusive.
    Repeated rows give repeated results; an empty table gives none.
    """
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                found = sorted(base + models.spans(t or "", base), key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans_type)], ["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(docs: DataFrame, models: Models, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` and n_chars counted again there; other rows and columns as they are, null and empty texts too."""
    columns = [c.lower() for c in docs.columns]
    place = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in batches:
            texts, lengths = batch.column(place).to_pylist(), batch.column(chars).to_pylist() if chars is not None else None
            for i, t in enumerate(texts):
                if not t:
                    continue
                base = base_spans(t)
                found = sorted((a, b) for _, a, b in base + models.spans(t, base))
                if not found:
                    continue
                parts, at = [], 0
                for a, b in found:
                    if b <= at:
                        continue
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = b
                texts[i] = "".join(parts) + t[at:]
                if lengths is not None:
                    lengths[i] = len(texts[i])
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, batch.schema.field(place).type)
            if chars is not None:
                arrays[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

