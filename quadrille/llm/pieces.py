"""SentencePiece encoding and decoding: a relational lattice of pieces over the corpus's distinct words."""

from __future__ import annotations

import heapq
import json
import pickle
import threading
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Words whose ids every worker holds: those in the most portions of texts.
HOT = 400_000
#: Distinct words that a task counts before it sends them on.
COUNTED = 250_000
#: Bytes of texts that a worker cuts at once.
AT_ONCE = 1 << 20
#: Partitions of distinct words for each shuffle partition: a word makes about 40 rows of its lattice.
SPREAD = 4
#: Code points of a word that go through the fold: those that fit the bits of a long with both ends, for merges, and
#: those whose state of paths stays small, for Viterbi. Longer ones go by ``merge`` and ``cheapest``, with the same result.
BITS, PATHS = 62, 512
#: What a character without a piece costs beyond the worst piece, in a unigram model.
PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds: pieces that text may match, with ids and scores; ids of single bytes; the kind of model."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown: int
    unigram: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown_cost(self) -> float:
        """Cost of a single character without a piece on a path of least cost."""
        return PENALTY - min((score for _, _, score in self.pieces), default=0.0)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation, with a dummy prefix, are read")
        normal = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED))
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p, _, _ in normal):
            raise ValueError("a piece crosses a word's edge")
        single = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        return cls(normal, tuple(single.get(f"<0x{b:02X}>", model.trainer_spec.unk_id) for b in range(256)), model.trainer_spec.unk_id, model.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank by score): as many rows as the model file has, which bounds what is broadcast."""
        best = sorted(self.pieces, key=lambda p: (-p[2], p[1]))
        return spark.createDataFrame([(p, i, r) for r, (p, i, _) in enumerate(best)], "piece string, id int, rank int")


class Cuts:
    """Cuts texts between characters that stand side by side in no piece.

    No piece spans such a place, so neither a merge nor a path of pieces crosses it: the
    ids of a text are those of its parts in a row, in any kind of model. Pairs of
    characters are marks in a table of slots; should two pairs share a slot, a place
    stays uncut, which is as right.
    """

    LOG_SLOTS = 20

    def __init__(self, pairs: list[str]):
        self.pairs = pairs
        chars = sorted(set("".join(pairs)))
        self.code = np.zeros(0x110000, np.uint32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.inside = np.zeros(1 << self.LOG_SLOTS, bool)
        if pairs:
            self.inside[self._slots(*(self.code[[ord(p[i]) for p in pairs]] for i in (0, 1)))] = True

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Cuts:
        return cls(sorted({a + b for p, _, _ in vocabulary.pieces for a, b in zip(p, p[1:])}))

    def __reduce__(self):
        return Cuts, (self.pairs,)

    def _slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)) >> np.uint32(32 - self.LOG_SLOTS)

    def parts(self, texts: list[str | None]) -> list[list[bytes]]:
        """The parts of each text as pieces see it, in UTF-8: with marks for spaces, and one before its start. Empty and null texts have none.

        All texts are looked at in one go. Spaces, of which none are left, are then put
        where a text is cut, and two of them between texts.
        """
        marked = [SPACE + t if t else "" for t in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        chars[chars == 32] = ord(SPACE)
        code = self.code[chars]
        apart = ~self.inside[self._slots(code[:-1], code[1:])]
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))[:-1]
        apart[ends[(ends > 0) & (ends < len(chars))] - 1] = False
        cuts = np.concatenate([np.flatnonzero(apart) + 1, ends, ends])
        data = np.insert(chars, cuts, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return [x.split(b" ") if x else [] for x in data.split(b"  ")] if texts else []

    def coded(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The same parts by number: the place of each text's first part and the end, the distinct parts, and each part's number among these."""
        marked = [SPACE + t if t else "" for t in texts]
        joined = "".join(marked).replace(" ", SPACE)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))])
        if not len(chars):
            return np.zeros(len(starts), np.int64), [], np.zeros(0, np.int32)
        code = self.code[chars]
        begins = np.append(True, ~self.inside[self._slots(code[:-1], code[1:])])
        begins[starts[starts < len(chars)]] = True
        wide = 1 + (chars > 0x7F).view(np.uint8) + (chars > 0x7FF).view(np.uint8) + (chars > 0xFFFF).view(np.uint8)
        at = np.flatnonzero(begins)
        ends = np.cumsum(wide, dtype=np.int64)
        offsets = np.append(ends[at] - wide[at], ends[-1]).astype(np.int32)
        data = pa.py_buffer(joined.encode("utf-8", "surrogatepass"))
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), data]).dictionary_encode()
        return np.searchsorted(at, starts), _objects(found.dictionary), found.indices.to_numpy()


def _objects(values) -> list:
    """An Arrow array as a list, converted all at once: without a scalar for each value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _portions(sizes: list[int]):
    """Ranges of texts that are worked on at once, about ``AT_ONCE`` bytes each."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= AT_ONCE:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _texts(batch, column: int):
    """(first row, end, texts) of the portions of a batch."""
    for a, b in _portions(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        yield a, b, batch.column(column).slice(a, b - a).to_pylist()


def _in_words(batches, cuts: Cuts):
    """Distinct words of a task's documents, and in how many portions of texts each was found."""
    counts: Counter[bytes] = Counter()

    def out():
        words = list(counts)
        for at in range(0, len(words), 16384):
            some = words[at : at + 16384]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"])

    for batch in batches:
        for _, _, texts in _texts(batch, 0):
            counts.update(cuts.coded(texts)[1])
            if len(counts) > COUNTED:
                yield from out()
                counts.clear()
    yield from out()


#: An edge as one long: rank of its piece by score, start, length (6 bits), id. An id of all ones: no piece, one character.
_RANK, _START, _LENGTH, _ID = 43, 26, 20, 20
_NONE = (1 << _ID) - 1


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (word, n, edges): every substring of the word that is a piece, or a single character.

    Substrings of bounded length are exploded, met with the piece table by equality, and
    grouped by word: ``words`` (word, n) is already dealt by word, so no row moves again.
    Edges are longs, in the order of score, then start; words that don't fit have none.
    """
    n = F.length("chunk")
    x = words.select("word", "n", F.col("word").alias("chunk"))
    x = x.select("word", "n", "chunk", F.explode_outer(F.when(_fits(n, vocabulary), F.sequence(F.lit(0), n - 1))).alias("s"))
    x = x.select("word", "n", "chunk", "s", F.explode_outer(F.when(F.col("s").isNotNull(), F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), n - F.col("s"))))).alias("k"))
    x = x.select("word", "n", "s", "k", F.substring("chunk", F.col("s") + 1, F.col("k")).alias("piece"))
    found = x.join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left").where("id is not null or k = 1 or s is null")
    rank = F.coalesce("rank", F.lit(len(vocabulary.pieces))).cast("long")
    edge = rank * (1 << _RANK) + F.col("s").cast("long") * (1 << _START) + F.col("k").cast("long") * (1 << _LENGTH) + F.coalesce("id", F.lit(_NONE)).cast("long")
    return found.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _bits(x: Column, low: int, wide: int) -> Column:
    return F.shiftright(x, low).bitwiseAND((1 << wide) - 1).cast("int")


def _fits(n: Column, vocabulary: Vocabulary) -> Column:
    return n <= (PATHS if vocabulary.unigram else BITS)


def _ids(chunk: Column, kept: Column, vocabulary: Vocabulary) -> Column:
    """The ids of edges (s, id) in the order of their starts; characters without a piece give those of their bytes."""
    raw = lambda e: F.regexp_extract_all(F.hex(F.encode(F.substring(chunk, e["s"] + 1, F.lit(1)), "utf-8")), F.lit("(..)"), F.lit(1))
    by_byte = lambda e: F.transform(raw(e), lambda h: F.get(F.array(*map(F.lit, vocabulary.byte_ids)), F.conv(h, 16, 10).cast("int")))
    return F.flatten(F.transform(kept, lambda e: F.when(e["id"] == _NONE, by_byte(e)).otherwise(F.array(e["id"]))))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _joined(cuts: Column, e: Column) -> Column:
    """Whether both ends of an edge are cuts and just one cut stands between them: two neighbours that the edge joins."""
    return (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1) & (cuts.bitwiseAND(e["ends"]) == e["ends"])


def merged(lattices: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (word, n, ids, left): each lattice folded in the order of its edges' scores, as a BPE model merges.

    The state is the set of cuts between characters, a bit each. The best-scored edge
    comes first, ties from the left; an edge that spans two neighbouring symbols removes
    the cut between them. left: words that don't fit, and those with an edge that still
    could, which a model whose parts score below their wholes might leave; these go by
    ``merge``.
    """
    place = lambda e: F.shiftright(e, _LENGTH).bitwiseAND(4095).cast("int")
    ends, inner = _masks()
    masks = lambda e: F.struct(F.get(ends, place(e)).alias("ends"), F.get(inner, place(e)).alias("inner"), e.alias("e"))
    wide = lambda e: F.shiftright(e, _LENGTH).bitwiseAND(63) > 1
    x = lattices.withColumn("fits", _fits(F.length("word"), vocabulary))
    x = x.withColumn("masks", F.transform(F.filter("edges", wide), masks))
    every = F.when(F.col("fits"), _bit(F.length("word") + 1) - 1).otherwise(F.lit(0).cast("long"))
    x = x.withColumn("cuts", F.aggregate("masks", every, lambda c, e: F.when(_joined(c, e), c.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(c)))
    cut = F.col("cuts")
    whole = F.filter("masks", lambda e: (cut.bitwiseAND(e["inner"]) == 0) & (cut.bitwiseAND(e["ends"]) == e["ends"]))
    single = F.filter("edges", lambda e: ~wide(e) & (cut.bitwiseAND(F.get(ends, place(e))) == F.get(ends, place(e))))
    kept = F.concat(F.transform(whole, lambda e: e["e"]), single)
    kept = F.sort_array(F.transform(kept, lambda e: F.struct(_bits(e, _START, 17).alias("s"), _bits(e, 0, _ID).alias("id"))))
    return x.select("word", "n", _ids(F.col("word"), kept, vocabulary).alias("ids"), (~F.col("fits") | F.exists("masks", lambda e: _joined(cut, e))).alias("left"))


def _masks() -> tuple[Column, Column]:
    """Arrays over 64 * start + length of an edge within ``BITS`` characters: bits of its ends, bits between them."""
    pairs = [(s, s + k if k and s + k <= BITS else None) for s in range(64) for k in range(64)]
    ends = [0 if e is None else 1 << s | 1 << e for s, e in pairs]
    inner = [0 if e is None else (1 << e) - (2 << s) for s, e in pairs]
    return F.from_json(F.lit(json.dumps(ends)), "array<long>"), F.from_json(F.lit(json.dumps(inner)), "array<long>")


def best_path(lattices: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (word, n, ids, left): each lattice folded into its path of least cost (Viterbi), as a unigram model segments.

    The state holds, for every place, the least cost of reaching it and the edges on the
    way; edges come by their end, then their start, and the longer edge wins a tie. left:
    words that don't fit, which go by ``cheapest``.
    """
    scores = [-score for _, _, score in sorted(vocabulary.pieces, key=lambda p: (-p[2], p[1]))] + [vocabulary.unknown_cost]
    costs = F.from_json(F.lit(json.dumps(scores)), "array<double>")
    x = lattices.withColumn("chunk", F.col("word"))

    def read(e):
        s = _bits(e, _START, 17)
        return F.struct((s + _bits(e, _LENGTH, 6)).alias("e"), s.alias("s"), _bits(e, 0, _ID).alias("id"), F.get(costs, F.shiftright(e, _RANK).cast("int")).alias("cost"))

    x = x.withColumn("by_end", F.sort_array(F.transform("edges", read)))
    none = F.array().cast("array<struct<s:int,id:int>>")
    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("cost"), none.alias("way")))

    def step(state, e):
        before = F.element_at(F.filter(state, lambda p: p["at"] == e["s"]), 1)
        way = F.concat(before["way"], F.array(F.struct(e["s"].alias("s"), e["id"].alias("id"))))
        now = F.struct(e["e"].alias("at"), (before["cost"] + e["cost"]).alias("cost"), way.alias("way"))
        last = F.element_at(state, -1)
        better = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.when(now["cost"] < last["cost"], now).otherwise(last)))
        return F.when(last["at"] == e["e"], better).otherwise(F.concat(state, F.array(now)))

    way = F.aggregate("by_end", start, step, lambda s: F.element_at(s, -1)["way"])
    fits = _fits(F.length("chunk"), vocabulary)
    return x.select("word", "n", F.when(fits, _ids(F.col("chunk"), way, vocabulary)).alias("ids"), (~fits).alias("left"))


def cheapest(chunk: str, costs: dict[str, tuple[float, int]], longest: int, unknown_cost: float, byte_ids: tuple[int, ...]) -> list[int]:
    """The path of least cost through one chunk of any length; the longer edge wins a tie."""
    n = len(chunk)
    cost, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - longest), e):
            own = costs.get(chunk[s:e])
            step = own[0] if own else unknown_cost if e - s == 1 else None
            if step is not None and cost[s] + step < cost[e]:
                cost[e], came[e] = cost[s] + step, s
    out: list[list[int]] = []
    while n:
        piece = chunk[came[n] : n]
        out.append([costs[piece][1]] if piece in costs else [byte_ids[x] for x in piece.encode("utf-8", "surrogatepass")])
        n = came[n]
    return [i for part in reversed(out) for i in part]


def merge(chunk: str, ranks: dict[str, tuple[float, int]], byte_ids: tuple[int, ...]) -> list[int]:
    """BPE of one chunk of any length, with a heap of neighbouring pairs."""
    n = len(chunk)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def push(a: int, b: int) -> None:
        if 0 <= a and b < n and (r := ranks.get(chunk[a : end[b]])):
            heapq.heappush(heap, (r[0], a, b, end[b]))

    for i in range(n - 1):
        push(i, i + 1)
    alive = [True] * n
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or after[a] != b or end[b] != e:
            continue
        alive[b], end[a], after[a] = False, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        push(before[a], a)
        push(a, after[a])
    out: list[int] = []
    i = 0
    while i < n:
        piece = chunk[i : end[i]]
        out += [ranks[piece][1]] if piece in ranks else [byte_ids[x] for x in piece.encode("utf-8", "surrogatepass")]
        i = after[i]
    return out


def dictionary(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (word, n, ids) for distinct words (columns word, n), dealt by word; ids as little-endian bytes of ``_kind``.

    Words of up to ``BITS`` (unigram: ``PATHS``) characters go through the lattice and its
    fold; longer ones, and any the fold leaves undone, go one by one by the same rule.
    """
    folded = (best_path if vocabulary.unigram else merged)(lattice(words, vocabulary), vocabulary)
    shared = words.sparkSession.sparkContext.broadcast({p: (-score, i) for p, i, score in vocabulary.pieces})
    byte_ids, kind, unigram, longest, unknown_cost = vocabulary.byte_ids, _kind(vocabulary), vocabulary.unigram, vocabulary.longest, vocabulary.unknown_cost

    def run(batches):
        ranks = shared.value
        for batch in batches:
            data = batch.column(2).flatten().to_numpy().astype(kind).tobytes()
            ends = (np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy())) * np.dtype(kind).itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            left = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            if len(left):
                packed = _objects(packed)
                for i in left.tolist():
                    w = batch.column(0)[i].as_py()
                    ids = cheapest(w, ranks, longest, unknown_cost, byte_ids) if unigram else merge(w, ranks, byte_ids)
                    packed[i] = np.array(ids, kind).tobytes()
                packed = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["word", "n", "ids"])

    return folded.mapInArrow(run, "word string, n long, ids binary")


def _kind(vocabulary: Vocabulary) -> str:
    return "<u2" if max(i for _, i, _ in vocabulary.pieces) < 1 << 16 else "<u4"


def _packed(batches):
    """A task's words and ids as one compressed list a batch."""
    for batch in batches:
        data = zstandard.ZstdCompressor().compress(pickle.dumps(dict(zip(_objects(batch.column(0).cast(pa.binary())), _objects(batch.column(1))))))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["blob"])


#: Seconds after which a worker that got no further task here lets its words go, as others' tasks may come to it.
IDLE = 15
_idle: list[threading.Timer] = []


def _held(shared) -> dict[bytes, bytes]:
    """The words that a worker holds, until it has been ``IDLE``."""
    while _idle:
        _idle.pop().cancel()
    _idle.append(threading.Timer(IDLE, _unpacked.cache_clear))
    _idle[0].daemon = True
    _idle[0].start()
    return _unpacked(shared)


@lru_cache(1)
def _unpacked(shared) -> dict[bytes, bytes]:
    """The words that a worker holds, unpacked once for all its tasks."""
    found: dict[bytes, bytes] = {}
    for blob in shared.value.value:
        found.update(pickle.loads(zstandard.ZstdDecompressor().decompress(blob)))
    return found


def _shared(value, number):
    made = object.__new__(_Shared)
    made.value, made.id = value, number
    return made


class _Shared:
    """A broadcast value that is equal to itself in later tasks of a worker."""

    def __init__(self, value):
        self.value, self.id = value, value._jbroadcast.id()

    def __reduce__(self):
        return _shared, (self.value, self.id)

    def __hash__(self):
        return hash(self.id)

    def __eq__(self, other):
        return self.id == other.id


def decoder(vocabulary: Vocabulary) -> list[bytes]:
    """What each id adds to a text."""
    out = [b""] * (1 + max(max(i for _, i, _ in vocabulary.pieces), *vocabulary.byte_ids))
    for p, i, _ in vocabulary.pieces:
        out[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(vocabulary.byte_ids):
        if i != vocabulary.unknown:
            out[i] = bytes([b])
    return out


class _Speller:
    """Spells many ids at once."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(parts), np.uint8)

    def texts(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.spelled[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def decode_ids(ids: list[int], parts: list[bytes]) -> str:
    """The text of ids, without the space put before it."""
    return b"".join([parts[i] for i in ids])[1:].decode("utf-8", "replace") if ids else ""


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (doc_id, ids) as rows (doc_id, text); null ids give a null text."""
    parts = decoder(vocabulary)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(x, parts) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _own(bounds: np.ndarray, words: list[bytes], index: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct parts that are ``new``, by text, then in their order as bytes: text, and number of the part."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.array(sorted(np.flatnonzero(new).tolist(), key=words.__getitem__), np.int64)
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(len(order))
    here = new[index]
    row, place = np.divmod(np.unique(row[here] * len(words) + rank[index[here]]), max(1, len(words)))
    return row, order[place]


def _grade(n: Column) -> Column:
    """An order of magnitude of a count, an eighth of a power of two wide: a few hundred values whatever the counts."""
    return F.floor(F.log2(n) * 8).cast("int")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, ids, round_trip): the ids of every whole text, as the model's own library gives them.

    Null and empty texts have no ids; an empty table gives no rows. round_trip: whether
    the ids decode to the text. Texts are cut where no piece can cross (``Cuts``),
    and each distinct part, here a word, is encoded once, in ``dictionary``; documents
    then take their ids from two portions of it: at most ``hot`` words, those in most
    portions of texts, which every worker holds, and each document's other words, joined by word and
    grouped by document, where a place among them stands for the word. Texts are
    compressed before they meet those. Rows that repeat are encoded alike; they are
    told apart by id and text.
    """
    spark = docs.sparkSession
    text, cuts = F.col(text_col).cast("string"), Cuts.of(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    counted = rows.select("text").mapInArrow(lambda it: _in_words(it, cuts), "word string, n long")
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"))
    table, _ = written(dictionary(counted, vocabulary), "pieces")

    least, total = 0, 0
    for r in sorted(table.groupBy(_grade(F.col("n")).alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        total += r["count"]
        if total > hot:
            least = r["grade"] + 1
            break
    known_to_all = _grade(F.col("n")) >= least
    blobs = table.where(known_to_all).select("word", "ids").mapInArrow(lambda it: _packed(it), "blob binary").collect()
    shared = _Shared(spark.sparkContext.broadcast([bytes(r["blob"]) for r in blobs]))
    kind, spelled = _kind(vocabulary), decoder(vocabulary)
    kind_size = np.dtype(kind).itemsize

    def rare(batches):
        known = _held(shared)
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                bounds, words, index = cuts.coded(texts)
                row, part = _own(bounds, words, index, np.array([w not in known for w in words], bool))
                keys = batch.column(0).slice(a, b - a).take(pa.array(row))
                places = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.array(places), pa.array(words, pa.string()).take(pa.array(part))], ["key", "place", "word"])

    def pack(batches):
        for batch in batches:
            z = zstandard.ZstdCompressor(level=3)
            data = [None if not t.is_valid else z.compress(t.as_buffer()) for t in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc_id", "key", "z"])

    def run(batches):
        known, z, speller = _held(shared), zstandard.ZstdDecompressor(), _Speller(spelled)

        def portion(some):
            texts = [z.decompress(data.as_buffer()) if data.is_valid else b"" for data in some.column(1)]
            bounds, words, index = cuts.coded([t.decode("utf-8", "surrogatepass") for t in texts])
            found = list(map(known.get, words))
            _, part = _own(bounds, words, index, np.array([x is None for x in found], bool))
            sent = some.column(2).flatten()  # the documents' own words, in the order of their places once sorted
            sent_row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(some.column(2)), 0).to_numpy())
            order = np.lexsort((sent.field("place").to_numpy(), sent_row))
            for i, own in zip(part.tolist(), _objects(sent.field("ids").take(pa.array(order)))):
                found[i] = own
            sizes = np.array([len(x) // kind_size for x in found], np.int64)
            begins, size = np.cumsum(sizes) - sizes, sizes[index]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = np.frombuffer(b"".join(found), kind)[np.repeat(begins[index] - ends[:-1], size) + np.arange(ends[-1])].astype(np.int32)
            offsets = ends[bounds].astype(np.int32)
            if speller.texts(flat) == b"".join([b" " + t for t in texts if t]):
                trips = [True] * len(texts)
            else:
                trips = [decode_ids(flat[a:b].tolist(), spelled).encode("utf-8", "surrogatepass") == t for a, b, t in zip(offsets, offsets[1:], texts)]
            return pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(trips, pa.bool_())], ["doc_id", "ids", "round_trip"])

        for batch in batches:
            for a, b in _portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                yield portion(batch.slice(a, b - a))

    wanted = rows.select("key", "text").mapInArrow(rare, "key long, place int, word string")
    own = wanted.join(table.where(~known_to_all).select("word", "ids"), "word").groupBy("key").agg(F.collect_set(F.struct("place", "ids")).alias("own"))
    texts = rows.select("doc_id", "key", "text").mapInArrow(pack, "doc_id long, key long, z binary")
    return texts.join(own, "key", "left").select("doc_id", "z", "own").mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")
