"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the embedding table and its width; filters of each width; words that a worker keeps projected.
BUCKETS, DIM, FILTERS, WIDTHS, KNOWN = 1 << 16, 16, 12, (1, 2, 3), 150_000
#: Bytes of a word that counts as one; scripts without spaces have longer ones.
PIECE = 64
#: Contract's threshold of ``predicted``.
PREDICTED = 0.7

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COLUMNS = [(w, o) for w in WIDTHS for o in range(w)]


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of letters a-z and of characters beyond ASCII; those beyond ``PIECE`` bytes in pieces that overlap by half."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()
    if all(len(w) <= PIECE for w in words):
        return words
    return [p for w in words for p in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]


def grams(word: bytes) -> list[int]:
    """Buckets of a word: its own, and those of its runs of three to five bytes with the edges marked."""
    w = b"<" + word + b">"
    parts = [word] + [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return [zlib.crc32(p) % BUCKETS for p in parts]


def embed(table: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of the table's rows for each word; and the buckets, and where each word's begin."""
    lists = [grams(w) for w in words]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((b for x in lists for b in x), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None].astype(np.float32), flat, starts


@dataclass
class Network:
    """Weights, and per-language thresholds. A score depends on the words alone."""

    table: np.ndarray
    filters: np.ndarray  # (one for each width and offset, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray
    shift: float
    scale: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = PREDICTED

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        n = len(WIDTHS) * FILTERS
        return cls(normal(BUCKETS, DIM) * 0.02, normal(len(_COLUMNS), DIM, FILTERS) * 0.5, np.zeros(n, np.float32), normal(n) * 0.3, 0.0)

    def project(self, words: list[bytes]) -> np.ndarray:
        """What each word adds at each offset of each filter: (words, offsets * FILTERS)."""
        return np.einsum("wd,cdf->wcf", embed(self.table, words)[0], self.filters).reshape(len(words), -1)

    def pooled(self, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: bool = False):
        """Maxima (and their places) of every filter over each document's rows; rows of zeros stand after each."""
        best, where = [], []
        for k, w in enumerate(WIDTHS):
            c = sum(WIDTHS[:k]) * FILTERS
            x = rows[:, c : c + FILTERS]
            for o in range(1, w):
                y = rows[o:, c + o * FILTERS : c + (o + 1) * FILTERS]
                x = x[: len(y)] + y
            if places:
                at = np.array([x[a : e + 1].argmax(0) + a for a, e in zip(begins, ends)])
                where.append(at)
                best.append(np.take_along_axis(x, at, 0))
            else:
                # from a document's first word to its first zero row, then the gap up to the next document
                cuts = np.stack([begins, np.minimum(ends + 1, len(x) - 1)], 1).reshape(-1)
                best.append(np.maximum.reduceat(x, cuts, axis=0)[::2])
        pooled = np.concatenate(best, 1) + self.bias
        return (pooled, where) if places else pooled

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.shift

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64), -60, 60)))


def layout(docs: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents with as many pads after each as the widest filter, so that no window reaches the next; where each begins and ends (before its pads)."""
    gap = max(WIDTHS)
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    flat = np.full(int((sizes + gap).sum()) + gap, pad, np.int64)
    for d, b in zip(docs, begins):
        flat[b : b + len(d)] = d
    return flat, begins, begins + sizes


class Scorer:
    """Scores batches of texts; keeps what words add, up to ``KNOWN`` words."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1, len(_COLUMNS) * FILTERS), np.float32)  # row 0: the pad

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.net.probability(self.logits(texts))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.rows = {}, self.rows[:1]
        new = list(set().union(*words).difference(self.known)) if words else []
        if new:
            n = len(self.rows)
            self.known.update(zip(new, range(n, n + len(new))))
            self.rows = np.concatenate([self.rows, self.net.project(new).astype(np.float32)])
        known = self.known
        out = []
        # documents together up to 65,536 words
        group: list[list[int]] = []
        size = 0
        for i, ws in enumerate(words):
            group.append([known[w] for w in ws])
            size += len(ws)
            if size > 65536 or i == len(words) - 1:
                flat, begins, ends = layout(group, 0)
                out.append(self.net.logits(self.net.pooled(self.rows[flat], begins, ends)).astype(np.float64))
                group, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[tuple[str | None, str | None, int]], rate: float | None = None, epochs: int = 6, steps: int = 800, batch: int = 32, seed: int = 7) -> Network:
    """A network from rows (text, lang, label); every fifth row calibrates scale, shift and the languages' thresholds.

    lang only picks which threshold a row calibrates. rate: share of label 1 among all
    labelled rows, to which the shift of a sample with another share is corrected.
    With one label or none the score is constant.
    """
    net = Network.new(seed)
    labels = np.array([r[2] for r in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        net.out[:] = 0
        net.shift = 4.0 if len(rows) and labels[0] else -4.0
        return net
    number: dict[bytes, int] = {}  # 0 is the pad
    docs = [np.fromiter((number.setdefault(w, len(number) + 1) for w in words_of(r[0])), np.int32) for r in rows]
    sizes, parts = [1], array("i", [0])
    for w in number:
        own = grams(w)
        sizes.append(len(own))
        parts.extend(own)
    buckets, sizes = np.frombuffer(parts, np.int32), np.array(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    del number
    held = np.arange(len(rows)) % 5 == 4
    if not 0 < labels[~held].sum() < (~held).sum():
        held[:] = False
    rng = np.random.default_rng(seed)
    todo = np.flatnonzero(~held)
    share = labels[todo].mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    flat_filters = lambda: net.filters.transpose(1, 0, 2).reshape(DIM, -1)
    squares = {k: np.full_like(getattr(net, k), 1e-8) for k in ("table", "filters", "bias", "out")}
    shift, shift_square = 0.0, 1e-8

    def stepped(name: str, grad: np.ndarray, at=slice(None)) -> None:
        squares[name][at] += grad**2
        getattr(net, name)[at] -= rate_of[name] * grad / np.sqrt(squares[name][at])

    rate_of = {"table": 0.3, "filters": 0.02, "bias": 0.02, "out": 0.05}
    for _ in range(max(epochs, -(-steps * batch // len(todo)))):
        order = rng.permutation(todo)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            flat, begins, ends = layout([docs[i] for i in some], 0)
            used, local = np.unique(flat, return_inverse=True)
            spread = np.repeat(starts[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(sizes[used].sum())
            firsts = np.cumsum(sizes[used]) - sizes[used]
            vectors = np.add.reduceat(net.table[buckets[spread]], firsts, axis=0) / sizes[used, None].astype(np.float32)
            vectors[used == 0] = 0
            pooled, where = net.pooled((vectors @ flat_filters())[local], begins, ends, places=True)
            keep = (rng.random(pooled.shape) > 0.2).astype(np.float32) / np.float32(0.8)
            active = np.maximum(pooled, 0) * keep
            logit = active @ net.out + shift
            g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            down = g[:, None] * net.out[None, :] * keep * (pooled > 0)
            d_filters, words, pushed = 1e-4 * net.filters, [], []
            for c, (w, o) in enumerate(_COLUMNS):
                k = WIDTHS.index(w)
                word = local[where[k] + o]  # (documents, FILTERS)
                d = down[:, k * FILTERS : (k + 1) * FILTERS]
                d_filters[c] += np.einsum("nf,nfd->df", d, vectors[word])
                on = (d != 0) & (used[word] > 0)
                words.append(word[on])
                pushed.append((d[:, :, None] * net.filters[c].T[None])[on])
            words, pushed = np.concatenate(words), np.concatenate(pushed)
            if len(words):
                hit, to = np.unique(words, return_inverse=True)
                dv = np.zeros((len(hit), DIM), np.float32)
                np.add.at(dv, to, pushed)
                n = sizes[used[hit]]
                rows_of = buckets[np.repeat(starts[used[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                own, to = np.unique(rows_of, return_inverse=True)
                dt = np.zeros((len(own), DIM), np.float32)
                np.add.at(dt, to, np.repeat(dv / n[:, None].astype(np.float32), n, axis=0))
                stepped("table", dt, own)
            stepped("filters", d_filters)
            stepped("bias", down.sum(0))
            stepped("out", active.T @ g + 1e-3 * net.out)
            shift_square += float(g.sum()) ** 2
            shift -= 0.05 * float(g.sum()) / shift_square**0.5
    net.shift = float(shift)
    _calibrate(net, rows, labels, held if held.any() else ~held, rate)
    return net


def _calibrate(net: Network, rows, labels: np.ndarray, use: np.ndarray, rate: float | None) -> None:
    """Scale and shift by logistic regression of the held rows' logits; then a threshold by language where enough rows are."""
    at = np.flatnonzero(use)
    logit, y = Scorer(net).logits([rows[i][0] for i in at]), labels[at]
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(2000):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        a -= 0.02 * float(((q - target) * logit).mean())
        b -= 0.1 * float((q - target).mean())
    a = max(a, 0.05)
    if rate and 0 < rate < 1 and 0 < labels.mean() < 1:
        b += float(np.log(rate / (1 - rate)) - np.log(labels.mean() / (1 - labels.mean())))
    net.scale, net.shift = a, net.shift + b / a
    p = net.probability(logit + b / a)

    def best(mine: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([p[mine], [PREDICTED]]))
        f1 = [2 * (hit := float(y[mine][p[mine] >= c].sum())) / max(1e-9, float((p[mine] >= c).sum()) + float(y[mine].sum())) for c in cuts]
        top = [c for c, f in zip(cuts, f1) if f == max(f1)]
        return PREDICTED if top[0] <= PREDICTED <= top[-1] else float(min(top, key=lambda c: abs(c - PREDICTED)))

    net.threshold = best(np.ones(len(at), bool))
    langs = [str(rows[i][1]) for i in at]
    for lang in sorted(set(langs)):
        mine = np.array([x == lang for x in langs])
        if y[mine].sum() >= 10 and (1 - y[mine]).sum() >= 10:
            net.thresholds[lang] = best(mine)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's label isn't learned from: crc32 of its id as text leaves 1 over 3."""
    x = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(x.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (1500, 2000), label: str = "toxic") -> Network:
    """A network from at most ``sample`` rows of label 1 and of label 0, those with the smallest hashed doc_id.

    Only rows that aren't held out take part. The bound holds for the ids that are
    broadcast and for the texts that reach the driver, however often an id repeats.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    chosen = marks.where("y = 1").orderBy(*order).limit(sample[0]).unionByName(marks.where("y = 0").orderBy(*order).limit(sample[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    joined = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(sum(sample))
    rows = [(r["text"], r["lang"], r["y"]) for r in joined.collect()]
    total = sum(counts.values())
    return train(rows, counts.get(1, 0) / total if total else None)


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, score, predicted, flagged) of every whole text; null and empty ones have the score of no words.

    predicted: score >= 0.7. flagged: score >= the threshold calibrated for the row's
    language (of all languages where it has none).
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                s = scorer.scores(some.column(1).to_pylist())
                cut = [model.value.thresholds.get(str(x), model.value.threshold) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64()), pa.array((s >= PREDICTED).astype(np.int32)), pa.array(s >= np.array(cut))], ["doc_id", "score", "predicted", "flagged"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, flagged boolean")
