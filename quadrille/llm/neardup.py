"""Near-duplicates: SimHash through an inverted index on positional bytes; shared shingles through an inverted index on prefixes."""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written
from .graph import components

#: Fingerprints of one posting that are compared in one go; longer postings are dealt as pairs of such blocks.
BLOCK = 512
#: The members of a component meet its smallest doc_id under so many salts, so that a large one isn't one task's.
SALTS = 16


def _votes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """How many of the hashes have each bit, from the highest bit of the first lane down."""
    votes = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384]
        rows = [part]
        for _ in range(lanes - 1):  # further lanes: the hash mixed once more
            x = rows[-1] + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            rows.append(x ^ (x >> np.uint64(31)))
        for lane, x in enumerate(rows):
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[64 * lane : 64 * lane + 64] += bits.sum(0, dtype=np.uint32)
    return votes


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of a text's shingles of ``width`` words, repeats included; of its whole word sequence where that is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(1, len(words) - width + 1))


def simhash(text: bytes | None, width: int = 3, lanes: int = 1) -> bytes:
    """Fingerprint of ``64 * lanes`` bits, highest bit first; zero without words (or text)."""
    hashes = _hashes(text, width)
    return np.packbits(_votes(hashes, lanes) * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, lanes: int = 1) -> DataFrame:
    """Rows (doc_id, h, fp): the SimHash of every whole text over shingles of ``width`` words, repeats included; h: a hash of the text.

    Texts are lower-cased in A-Z; words are runs of non-white-space (ASCII). Null and
    wordless texts have the zero fingerprint, shorter ones that of their whole word sequence.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = [simhash(t.as_py(), width, lanes) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["doc_id", "h", "fp"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, h long, fp binary")


def byte_groups(lanes: int = 1) -> list[tuple[int, ...]]:
    """Groups of three byte positions, each the key of one inverted list.

    One lane (8 bytes): all triples of each half. Two fingerprints that share five or
    more positional bytes share three in one half, so they meet in some list: with at
    most three differing bits that is guaranteed. More lanes: triples at eight strides
    through all bytes, 256 for four lanes; no count is guaranteed there, so near-dedup
    by similarity goes through ``candidates``.
    """
    if lanes == 1:
        return [g for half in (range(4), range(4, 8)) for g in combinations(half, 3)]
    n = 8 * lanes
    groups: list[tuple[int, ...]] = []
    for a, b in ((1, 2), (3, 7), (5, 14), (4, 17), (6, 19), (9, 20), (11, 18), (10, 22)):
        groups += [g for at in range(n) if (g := tuple(sorted((at, (at + a) % n, (at + b) % n)))) not in groups]
    return groups


def forest(fps: np.ndarray, max_bits: int, min_bytes: int):
    """Pairs of row numbers that span the groups of linked fingerprints (rows of 64-bit lanes).

    Every row is taken once and compared with the rows not yet reached: its shared
    positional bytes are tallied, those with ``min_bytes`` are kept, and their
    differing bits counted. Memory is in proportion to the rows, and there are fewer
    pairs than rows, however many links there are.
    """
    left = np.arange(len(fps))
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            x = fps[left] ^ fps[at]
            near = (x.view(np.uint8).reshape(len(left), -1) == 0).sum(1) >= min_bytes
            near[near] = np.bitwise_count(x[near]).sum(1) <= max_bits
            if near.any():
                for other in left[near]:
                    yield at, other
                queue.extend(left[near])
                left = left[~near]


def links(distinct: DataFrame, max_bits: int = 3, lanes: int = 1) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) at ``max_bits`` or fewer differing bits.

    Enough edges to connect whatever is linked, not all pairs. Fingerprints are
    posted under each of ``byte_groups``; lists with one entry are dropped; longer
    ones than ``BLOCK`` are dealt as pairs of blocks, so that no task holds a whole
    hot list. A hash of group and bytes names a list: should two lists share it, they
    are merely compared together. With one lane the result is exact.
    """
    guaranteed = max(3, 8 * lanes - max_bits)
    min_bytes = guaranteed if lanes == 1 else 3
    keys = F.array(*[F.xxhash64(F.lit(k), F.concat(*[F.substring("fp", i + 1, 1) for i in g])) for k, g in enumerate(byte_groups(lanes))])
    posted = distinct.select("fp", F.explode(keys).alias("list"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("list", F.least("own", j), F.greatest("own", j)))
    dealt = posted.join(sizes, "list").withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.select("fp", F.explode(F.when(F.col("blocks") == 1, F.array("list")).otherwise(pairs)).alias("part"))

    def run(batches):
        part, held = None, []

        def flush():
            rows = np.frombuffer(b"".join(held), np.uint64).reshape(len(held), lanes)
            a, b = [], []
            for i, j in forest(rows, max_bits, min_bytes):
                a.append(held[i])
                b.append(held[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for p, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    if len(held) > 1:
                        yield flush()
                    part, held = p, []
                held.append(fp)
        if len(held) > 1:
            yield flush()

    grouped = dealt.select("part", "fp").repartition("part").sortWithinPartitions("part", "fp")
    return grouped.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, lanes: int = 1) -> DataFrame:
    """Rows (doc_id, h, fp, component_id) for every row of ``docs``; h is a hash of its text.

    component_id is the smallest doc_id reachable over links of ``max_bits`` or fewer
    differing bits, the row's own included (null where all of them are null). Equal
    fingerprints are one node, so that copies cost nothing beyond a combined minimum.
    Repeated rows give repeated results; an empty table gives none.
    """
    prints, _ = written(fingerprints(docs, id_col, text_col, width, lanes), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(links(nodes.select("fp"), max_bits, lanes))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    rooted = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"), salt)
    roots = rooted.where("linked").groupBy("root").agg(F.min("least").alias("smallest")).select("root", "smallest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    classes = rooted.join(roots, ["root", "salt"], "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "h", "fp", "component_id")


#: Wide fingerprints of whole documents: words in a shingle, lanes of 64 bits, and the mean number of differing bits at J = 0.8.
#: Texts that share J = 0.8 of their shingles have a cosine of 2J / (1 + J) = 0.89, an angle of 0.15 pi, and 38 of 256 bits.
#: About half of such pairs differ in more; those in more than ``NEAR`` are fewer than one in 10^12, and unlike texts differ in 128. Sets of
#: fewer than ``FEW`` shingles, whose bits vary more, aren't told apart by them.
STAGE_WIDTH, STAGE_LANES, STAGE_BITS, NEAR, FEW = 5, 4, 38, 88, 64
#: Shingles in more prefixes than ``COMMON`` go to the end of the order of shingles, where they are too many for an eighth of the marks only the
#: most frequent. Tables of marks have ``SLOTS`` bits, whatever the input: a mark that another value has set costs time, never a result.
COMMON, SLOTS = 2, 1 << 24
#: Lists of so many sets are compared all together, a batch at a time; longer ones each by itself.
SHORT = 8


class Marks:
    """A broadcast table of bits: which values of a column are marked, and perhaps some others."""

    def __init__(self, found: DataFrame):
        """``found`` has one column of longs. At most ``SLOTS`` numbers come to the driver."""
        self.slots = SLOTS
        slots = found.toDF("x").select(F.col("x").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
        bits = np.zeros(SLOTS, np.uint8)
        bits[slots] = 1
        self.shared = found.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def of(self, values: np.ndarray) -> np.ndarray:
        slots = values & (self.slots - 1)
        return (np.frombuffer(self.shared.value, np.uint8)[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)

    def column(self, name: str):
        """Whether a row's value is marked, as a column."""
        return F.arrow_udf(lambda values: pa.array(self.of(values.to_numpy())), "boolean")(name)


def _source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _shingled(batches, width: int = STAGE_WIDTH):
    """Batches (doc_id, h, text) as (doc_id, h, key, shingles): the distinct shingle hashes of every whole text, ascending; key: a hash of that set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sets = [np.unique(_hashes(t.as_py(), width).view(np.int64)) for t in some.column(2).cast(pa.large_binary())]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys), lists], ["doc_id", "h", "key", "shingles"])


def _sets(batches):
    """Batches (key, shingles) of texts."""
    for batch in _shingled(batches):
        yield batch.select(["key", "shingles"])


def signature(shingles: np.ndarray) -> bytes:
    """The wide SimHash of a set of shingle hashes, and 256 bits of parity: each shingle turns one of them over."""
    x = shingles.view(np.uint64)
    parity = np.packbits(np.bincount((x >> np.uint64(7) & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1)
    return np.packbits(_votes(x, STAGE_LANES) * 2 > len(x)).tobytes() + parity.tobytes()


def _signed(batches):
    """Batches with the columns key and shingles at the end as those before it, key, n and sig: the number of shingles and their ``signature``."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sigs = pa.array([signature(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends).astype(np.int32)), sigs], [*batch.schema.names[:-1], "n", "sig"])


def near(n, m, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles with signatures ``x`` and ``y`` (rows of 64-bit lanes) may have J >= 0.8.

    Such sets differ in a ninth of n + m shingles or fewer, and so in no more bits of
    parity. Their fingerprints differ in ``NEAR`` bits or fewer.
    """
    bits = np.bitwise_count(x ^ y)
    least, most = np.minimum(n, m), np.maximum(n, m)
    far = (bits[:, :STAGE_LANES].sum(1, dtype=np.int64) > NEAR) & (least >= FEW)
    return (5 * least >= 4 * most) & (bits[:, STAGE_LANES:].sum(1, dtype=np.int64) * 9 <= least + most) & ~far


def least_prefix(n):
    """How many of ``n`` shingles, the first in any order common to all sets, hold one of another set with J >= 0.8: that shares 4/5 of n or more."""
    return n - (4 * n + 4) // 5 + 1


def _whole(batches):
    """Batches sorted by their first column, cut anew so that rows of one value there come together."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        first = batch.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def _near_pairs(batches):
    """Batches (list, key, n, sig) by list as edges (a, b): enough to connect all sets of a list that are ``near``."""
    for batch in _whole(batches):
        part, key, n = (batch.column(i).to_numpy() for i in range(3))
        n = n.astype(np.int64)
        sigs = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(begins, len(part)))
        after = np.repeat(begins + sizes, sizes) - np.arange(len(part))  # rows of the list from this one on
        short = np.repeat(sizes <= SHORT, sizes)
        found = []
        for k in range(1, SHORT):
            i = np.flatnonzero(short & (after > k))
            i = i[near(n[i], n[i + k], sigs[i], sigs[i + k])]
            found.append(np.stack([key[i], key[i + k]], 1))
        for at, size in zip(begins[sizes > SHORT], sizes[sizes > SHORT]):
            left = np.arange(at, at + size)
            while left.size > 1:
                queue, left = [left[0]], left[1:]
                while queue and left.size:
                    one = queue.pop()
                    linked = near(n[left], n[one], sigs[left], sigs[one])
                    found.append(np.stack([np.full(linked.sum(), key[one]), key[left[linked]]], 1))
                    queue.extend(left[linked])
                    left = left[~linked]
        edges = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _in_lists(batches):
    """Postings (s, n, key) by shingle, size and key as lists (list, key): sets whose sizes allow a link to the next one, two or more.

    Lists longer than ``BLOCK`` come as edges of neighbours instead: list is null, and
    other the neighbour. Copies of a posting are one.
    """
    held, chained = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64)], False
    for batch in chain(batches, [None]):
        last = batch is None
        s, n, key = held if last else (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns))
        if not len(s):
            continue
        new = np.append(True, (s[1:] != s[:-1]) | (key[1:] != key[:-1]))
        s, n, key = s[new], n[new], key[new]
        apart = (s[1:] != s[:-1]) | (5 * n[:-1].astype(np.int64) < 4 * n[1:].astype(np.int64))
        begins = np.flatnonzero(np.append(True, apart))
        sizes = np.diff(np.append(begins, len(s)))
        long = sizes > BLOCK
        long[0] |= chained
        held, chained = [np.zeros(0, x.dtype) for x in (s, n, key)], False
        if not last:  # the last list may go on; of a long one its end is enough
            keep = len(s) - 1 if long[-1] else begins[-1]
            held, chained = [x[keep:] for x in (s, n, key)], bool(long[-1])
            if not long[-1]:
                s, n, key, begins, sizes, long = s[:keep], n[:keep], key[:keep], begins[:-1], sizes[:-1], long[:-1]
        listed = np.repeat((sizes > 1) & ~long, sizes)
        linked = np.repeat(long, sizes)[1:] & ~apart[: max(0, len(s) - 1)] if len(s) else np.zeros(0, bool)
        name = np.repeat(s[begins] ^ (key[begins] * np.int64(0x9E3779B97F4A7C1)), sizes)
        i, j = np.flatnonzero(listed), np.flatnonzero(linked)
        none = lambda x: pa.nulls(len(x), pa.int64())
        columns = [[pa.array(name[i]), none(j)], [pa.array(key[i]), pa.array(key[j])], [none(i), pa.array(key[j + 1])]]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["list", "key", "other"])


def candidates(source: DataFrame, sets=iter, signed: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of keys that connect, over any number of steps, every two sets with J >= 0.8; others may be connected too.

    Two such sets share a shingle within their prefixes, whatever the order of all
    shingles. Here common ones come last, so that a passage of many texts joins only
    texts that consist of little else; common is what a count of all prefixes, by 31 bits
    of the hash, finds often. ``sets`` turns batches of ``source`` into batches (key,
    shingles), in the worker that uses them. A list is sorted by size and cut where the next
    set is too large for the one before, and so for all before. Within a list sets are
    joined that are ``near`` by their signatures (``signed``: key, n, sig; reckoned here
    where not given), so that chance meetings don't grow together with the table; in
    lists longer than ``BLOCK`` neighbours are joined without a look.
    """

    def heads(batches):
        for batch in sets(batches):
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = [flat[a : a + least_prefix(b - a)] for a, b in zip(ends[:-1], ends[1:]) if b > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(out) & (1 << 31) - 1).astype(np.int32))], ["s"])

    often = source.mapInArrow(heads, "s int").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > COMMON)
    often, path = written(often, "often")
    least, total = COMMON, 0
    for r in sorted(often.groupBy(F.floor(F.log2("n") * 8).alias("grade")).agg(F.count("*").alias("of"), F.min("n").alias("least")).collect(), key=lambda r: -r["grade"]):
        total += r["of"]
        if total > SLOTS // 8:
            break
        least = r["least"] - 1
    else:
        least = COMMON
    common = Marks(often.where(F.col("n") > least).select(F.col("s").cast("long")))
    drop(source.sparkSession, path)

    def post(batches):
        for batch in sets(batches):
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                lists = some.column(1)
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                out, sizes = [], np.diff(ends)
                last = common.of(flat)
                for a, b in zip(ends[:-1], ends[1:]):
                    x, late = flat[a:b], last[a:b]
                    out.append(np.concatenate([x[~late], x[late]])[: least_prefix(b - a)])
                n = np.array([len(x) for x in out], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(sizes, n).astype(np.int32)), pa.array(np.repeat(some.column(0).to_numpy(), n))], ["s", "n", "key"])

    posted = source.mapInArrow(post, "s long, n int, key long").repartition("s").sortWithinPartitions("s", "n", "key")
    found, _ = written(posted.mapInArrow(_in_lists, "list long, key long, other long"), "lists")
    if signed is None:
        signed = source.mapInArrow(lambda it: _signed(sets(it)), "key long, n int, sig binary")
    entries = found.where("other is null").join(signed.dropDuplicates(["key"]).hint("merge"), "key").select("list", "key", "n", "sig")
    linked = entries.repartition("list").sortWithinPartitions("list").mapInArrow(_near_pairs, "a long, b long")
    return linked.unionAll(found.where("other is not null").select("key", "other")).distinct()


def alike(sets: list[np.ndarray]):
    """Pairs of places in ``sets`` that span the groups linked by J >= 0.8. Shared shingles are counted, none are estimated."""
    k, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    flat, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(flat, kind="stable")
    new = np.diff(flat[order], prepend=flat[order[0]]) != 0
    new[0] = True
    firsts = np.flatnonzero(new)
    lengths = np.diff(np.append(firsts, len(flat)))
    number = np.empty(len(flat), np.int64)
    number[order] = np.cumsum(new) - 1
    holders = np.repeat(np.arange(k), sizes)[order]
    left = np.ones(k, bool)
    for start in range(k):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue and left.any():
            at = queue.pop()
            mine = number[ends[at] : ends[at + 1]]
            mine = mine[lengths[mine] > 1]
            n = lengths[mine]
            shared = np.bincount(holders[np.repeat(firsts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=k)
            near = np.flatnonzero(left & (9 * shared >= 4 * (sizes + sizes[at])))
            left[near] = False
            queue.extend(near)
            for other in near:
                yield at, other


def compared(source: DataFrame, sets, dealt: DataFrame) -> DataFrame:
    """Edges (a, b) of keys that span, within each part of ``dealt`` (key, part), the groups of sets linked by J >= 0.8.

    Sets of other keys stay where they are. Joins are by sorting, so that adaptive
    execution splits a hot key's.
    """
    wanted = Marks(dealt.select("key"))

    def some(batches):
        for batch in sets(batches):
            yield batch.filter(pa.array(wanted.of(batch.column(0).to_numpy())))

    members = source.mapInArrow(some, "key long, shingles array<long>").dropDuplicates(["key"]).join(dealt.hint("merge"), "key")

    def run(batches):
        part, keys, held = None, [], []

        def flush():
            found = list(alike(held))
            a, b = ([keys[pair[i]] for pair in found] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (p, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if p != part:
                    if len(held) > 1:
                        yield flush()
                    part, keys, held = p, [], []
                keys.append(key)
                held.append(flat[ends[i] : ends[i + 1]].copy())
        if len(held) > 1:
            yield flush()

    grouped = members.select("part", "key", "shingles").repartition("part").sortWithinPartitions("part", "key")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def print_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) of keys whose wide SimHash prints (``prints``: key, fp; keys distinct) differ in ``STAGE_BITS`` bits or fewer.

    SimHash's inverted lists: every print is posted under the triples of positional bytes
    of each of its lanes (``byte_groups``); in a list, the shared bytes of two prints are
    tallied and their differing bits counted. Enough edges to connect what a list links.
    A list longer than ``BLOCK`` is dealt as blocks, which every list cuts otherwise.
    Prints that share no triple don't meet, and at J = 0.8 many pairs differ in more
    bits: such pairs are left to ``candidates``.
    """
    groups = [[8 * lane + i for i in g] for lane in range(STAGE_LANES) for g in byte_groups()]
    lists = F.array(*[F.xxhash64(F.lit(k), F.concat(*[F.substring("fp", i + 1, 1) for i in g])) for k, g in enumerate(groups)])
    posted = prints.select("key", F.explode(lists).alias("list"))
    posted = posted.withColumn("size", F.count("*").over(Window.partitionBy("list"))).where("size > 1")
    block = F.pmod(F.xxhash64("list", "key"), F.ceil(F.col("size") / F.lit(BLOCK)))
    part = F.when(F.col("size") <= BLOCK, F.col("list")).otherwise(F.xxhash64("list", block))
    dealt = posted.select("key", part.alias("part")).join(prints.hint("merge"), "key").select("part", "key", "fp")

    def run(batches):
        for batch in _whole(batches):
            part, key = (batch.column(i).to_numpy() for i in range(2))
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(key), -1)
            begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            found = [(a + i, a + j) for a, b in zip(begins, np.append(begins[1:], len(part))) for i, j in forest(fps[a:b], STAGE_BITS, 3)]
            pairs = np.unique(key[np.array(found, np.int64).reshape(-1, 2)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("part").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long").distinct()


def _by_prints(edges: DataFrame) -> DataFrame:
    """Parts (key, part) of the groups that ``edges`` connect: whole ones, or blocks of those beyond ``BLOCK``, each with the group's smallest key."""
    stars, _ = written(components(edges), "stars")
    blocks = stars.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    members = stars.where("node <> root").join(blocks.hint("merge"), "root").select(F.col("node").alias("key"), F.xxhash64("root", own).alias("part"))
    roots = blocks.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own"))
    return members.unionAll(roots.select(F.col("root").alias("key"), F.xxhash64("root", "own").alias("part")))


def _by_blocks(large: DataFrame, found: DataFrame) -> DataFrame:
    """Parts (key, part) that bring together every two sets of a group (node, root) but those both in its largest class so far, by edges ``found``."""
    classes = large.join(components(found).withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    most = classes.groupBy("root", "class").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("most"), F.max("n").alias("in_most"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    x = classes.join(most, "root").where("n > in_most").withColumns({"rest": blocks(F.col("n") - F.col("in_most")), "settled": blocks(F.col("in_most")), "apart": F.col("class") != F.col("most")})
    x = x.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("rest")).otherwise(F.col("settled"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = F.transform(upto("rest"), lambda j: F.xxhash64("root", F.lit(0), F.least("own", j), F.greatest("own", j)))
    others = F.transform(upto("settled"), lambda j: F.xxhash64("root", F.lit(1), "own", j))
    theirs = F.transform(upto("rest"), lambda j: F.xxhash64("root", F.lit(1), j, "own"))
    return x.select(F.col("node").alias("key"), F.explode(F.when(F.col("apart"), F.concat(own, others)).otherwise(theirs)).alias("part"))


def similar(source: DataFrame, sets=iter, signed: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of keys that span the groups of sets (key, shingles) linked by J >= 0.8; every link counted on the sets.

    ``source`` (turned into sets as in ``candidates``) is read anew for each step rather than kept: it is larger than the texts.
    SimHash comes first: sets whose prints its inverted lists link are compared, and those
    with J >= 0.8 are classes. ``candidates`` then finds what SimHash may have missed: groups of
    candidates that hold more than one class come together with their sets. Of one larger than
    ``BLOCK``, all that aren't in the group's largest class meet all of the group, as pairs of blocks; the members of
    that class needn't meet again, so that a large group of near copies isn't moved once for each block.
    """
    if signed is None:
        signed = source.mapInArrow(lambda it: _signed(sets(it)), "key long, n int, sig binary")
    signed, _ = written(signed.dropDuplicates(["key"]), "signed")
    parts, _ = written(_by_prints(print_links(signed.select("key", F.substring("sig", 1, 8 * STAGE_LANES).alias("fp")))), "parts")
    first, _ = written(compared(source, sets, parts), "linked")
    groups, _ = written(components(candidates(source, sets, signed).unionAll(first)), "groups")
    classes = groups.join(components(first).withColumnRenamed("root", "class").hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    unsettled = classes.groupBy("root").agg(F.count("*").alias("size"), F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    sized, _ = written(groups.join(unsettled.select("root", "size").hint("merge"), "root"), "unsettled")
    if sized.isEmpty():
        return first
    parts = sized.where(F.col("size") <= BLOCK).select(F.col("node").alias("key"), F.col("root").alias("part"))
    large = sized.where(F.col("size") > BLOCK).select("node", "root")
    if not large.isEmpty():
        parts, _ = written(parts.unionAll(_by_blocks(large, first)), "parts")
    return first.unionAll(compared(source, sets, parts)).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, as it is: that of the smallest doc_id (null ids last), then text hash.

    Links are texts whose sets of five-word shingles have J >= 0.8, every such pair. Rows that
    repeat a doc_id and text are one document, of which any row stays. Texts without words,
    null ones among them, are one group. An empty table gives none. Columns may have any
    names. Only rows that may go are moved; the others stay where they are read.
    """
    source = _source(docs)

    prints = source.mapInArrow(lambda it: _signed(_shingled(it)), "doc_id long, h long, key long, n int, sig binary")
    prints, _ = written(prints.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "key", "n", "sig"), "prints")
    stars = components(similar(source, _sets, prints.select("key", "n", "sig")))
    found = prints.join(stars.hint("merge"), F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "key"))
    first = F.min(F.struct("none", "id", "h")).alias("x")
    kept, _ = written(found.groupBy("group").agg(first).select("x.*").distinct(), "kept")
    ids = ["none", "id", "h"]
    slot = F.xxhash64(*ids)
    doubtful = prints.groupBy(*ids).agg(F.count("*").alias("times")).join(kept.withColumn("stays", F.lit(True)).hint("merge"), ids, "left").where("times > 1 or stays is null")
    marks = Marks(doubtful.select(slot))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h")).withColumn("slot", slot)
    marked = marks.column("slot")
    moved = rows.where(marked).dropDuplicates(ids).join(kept.hint("merge"), ids, "left_semi")
    return rows.where(~marked).select("row.*").unionAll(moved.select("row.*"))
