import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import neardup
from quadrille.llm.graph import components

from . import cases


def brute_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if len(words) > width else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(items, prints, bits):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(items))]


def test_query_against_brute_force(spark):
    rows = cases.rows()
    found = neardup.near_duplicates(cases.table(spark)).collect()
    prints = [brute_print(r[1]) for r in rows]
    classes = brute_classes([r[0] for r in rows], prints, 3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(((r.doc_id, int.from_bytes(r.fp, "big"), r.component_id) for r in found), key=key) == sorted(zip([r[0] for r in rows], prints, classes), key=key)


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    got = spark.sql("select 'the cold river' as s").select(F.xxhash64("s").alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"the cold river", 42)


def test_links_over_hot_lists(spark):
    """Fingerprints around a few centres, in lists longer than a block, keep every class."""
    rng = random.Random(3)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(500):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    frame = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    block, neardup.BLOCK = neardup.BLOCK, 100
    try:
        stars = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(neardup.links(frame)).collect()}
    finally:
        neardup.BLOCK = block
    assert [stars.get(v, v) for v in values] == brute_classes(values, values, 3)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    kept = neardup.one_of_each(cases.table(spark))
    assert kept.columns == cases.table(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 8 not in ids and 0 in ids and 1 not in ids and None not in ids
    assert {4, 9, 10, 11, 12, 13} <= set(ids)
    assert neardup.one_of_each(cases.empty(spark)).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    names = ["_id", "_h", "_none", "row", "none", "id", "h", "slot", "key", "group", "part", "a.b"]
    docs = cases.table(spark)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    columns = [f"`{c}`" for c in docs.columns]
    kept = neardup.one_of_each(docs)
    assert kept.schema == docs.schema
    assert kept.count() == neardup.one_of_each(cases.table(spark)).count()
    assert kept.select(*columns).exceptAll(docs.select(*columns)).count() == 0


def test_full_marks_change_nothing(spark, monkeypatch):
    """Marks are a shortcut: with a table of one bit, every row goes the long way."""
    docs = cases.table(spark)
    want = sorted((str(r) for r in neardup.one_of_each(docs).collect()))
    monkeypatch.setattr(neardup, "SLOTS", 8)
    assert sorted((str(r) for r in neardup.one_of_each(docs).collect())) == want


def test_wide_prints_find_similar_texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 3000, 400)]
    near = words.copy()
    near[50] = near[300] = "other"
    a, b = (np.frombuffer(neardup.simhash(" ".join(w).encode(), 5, 4), np.uint64) for w in (words, near))
    c = np.frombuffer(neardup.simhash(" ".join(words[::-1]).encode(), 5, 4), np.uint64)
    assert np.bitwise_count(a ^ b).sum() <= neardup.STAGE_BITS < np.bitwise_count(a ^ c).sum()


def edited(rng, words, n):
    """A copy with ``n`` words replaced, far apart or next to each other."""
    words, at = list(words), rng.randrange(len(words))
    for i in range(n):
        words[(at + i if n % 2 else rng.randrange(len(words))) % len(words)] = f"x{rng.randrange(10**6)}"
    return words


def test_stage_against_true_jaccard(spark):
    """Every pair with J of 0.8 or more is linked and no other, however short the texts and whatever passage they share."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = ["one two three", "One two  three", "one two four"]
    for n in (12, 30, 50, 100, 300) * 8:
        base = [f"w{rng.randrange(2000)}" for _ in range(n)] + (passage if n > 30 else [])
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, max(1, n // 25)))) for _ in range(3)]
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    spread = []
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            share = shared / (len(sets[i]) + len(sets[j]) - shared)
            spread.append(share)
            if share >= 0.8:
                root[find(i)] = find(j)
    assert sum(0.8 <= x < 0.9 for x in spread) > 30 and sum(0.6 < x < 0.8 for x in spread) > 30
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (neardup.BLOCK, 3):
        before, neardup.BLOCK = neardup.BLOCK, block
        try:
            assert sorted(r.doc_id for r in neardup.one_of_each(docs).collect()) == sorted(least.values())
        finally:
            neardup.BLOCK = before


def test_candidates_connect_every_similar_pair(spark):
    rng = random.Random(12)
    assert len(neardup.byte_groups(4)) == 256
    sets = []
    for n in (10, 40, 300):
        for share in (0.8, 0.82, 0.85, 0.9):
            for _ in range(10):
                a = {rng.getrandbits(62) for _ in range(n)}
                gone = int(n * (1 - share) / (1 + share) + 1e-9)
                b = set(list(a)[gone:]) | {rng.getrandbits(62) for _ in range(gone)}
                assert len(a & b) >= 0.8 * len(a | b)
                sets += [sorted(a), sorted(b)]
    frame = spark.createDataFrame(list(enumerate(sets)), "key long, shingles array<long>")
    stars = {r.node: r.root for r in components(neardup.candidates(frame)).collect()}
    assert all(stars[i] == stars[i + 1] for i in range(0, len(sets), 2))


def test_chance_meetings_make_no_groups(spark, monkeypatch):
    """Unlike texts that share a passage don't come together, even where full marks let its shingles into all prefixes."""
    rng = random.Random(4)
    monkeypatch.setattr(neardup, "SLOTS", 8)
    passage = [rng.getrandbits(62) for _ in range(40)]
    sets = [sorted(passage + [rng.getrandbits(62) for _ in range(rng.choice((20, 60, 400)))]) for _ in range(200)]
    sets.append(sorted(sets[0][:-1] + [rng.getrandbits(62)]))
    frame = spark.createDataFrame(list(enumerate(sets)), "key long, shingles array<long>")
    assert {tuple(sorted(r)) for r in neardup.candidates(frame).collect()} == {(0, 200)}


def test_a_class_of_near_copies_is_not_moved_for_each_block(spark, monkeypatch):
    """In a large group, only pairs outside its largest class meet again, and each of these does."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    large = spark.createDataFrame([(i, 0) for i in range(60)], "node long, root long")
    star = lambda n: spark.createDataFrame([(0, i) for i in range(1, n)], "a long, b long")
    assert neardup._by_blocks(large, star(60)).count() == 0
    parts = {}
    for r in neardup._by_blocks(large, star(50)).collect():
        parts.setdefault(r.part, set()).add(r.key)
    for i in range(60):
        for j in range(max(50, i + 1), 60):
            assert any({i, j} <= p for p in parts.values())
    assert sum(map(len, parts.values())) < 60 * 60 / 4 / 2


def test_the_stage_compares_simhash_prints():
    """Signatures hold the wide SimHash of the set; pairs with J of 0.8 or more are never told apart by it, unlike ones are."""
    text = " ".join(f"w{i}" for i in range(500))
    assert neardup.signature(np.unique(neardup._hashes(text.encode(), 5)).view(np.int64))[:32] == neardup.simhash(text.encode(), 5, 4)
    rng = np.random.default_rng(6)
    for n in (1, 4, 5, 9, 40, 64, 300, 3000):
        for _ in range(30):
            a = rng.integers(0, 1 << 62, n)
            gone = int(n / 9)
            for b in (np.concatenate([a[gone:], rng.integers(0, 1 << 62, gone)]), a[: max(1, -(-4 * n // 5))], rng.integers(0, 1 << 62, n)):
                x, y = (np.frombuffer(neardup.signature(v), np.uint64).reshape(1, -1) for v in (a, b))
                shared = len(np.intersect1d(a, b))
                if shared >= 0.8 * (len(a) + len(b) - shared):
                    assert neardup.near(np.array([len(a)]), np.array([len(b)]), x, y)[0]
                elif n > 4:
                    assert not neardup.near(np.array([len(a)]), np.array([len(b)]), x, y)[0]


def test_simhash_lists_come_first(spark, monkeypatch):
    """The stage links near copies by SimHash's inverted lists alone, where the exact way finds no candidates."""
    rng = random.Random(21)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base[:200] + ["other"] + base[201:])]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(neardup, "candidates", lambda *_: none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.one_of_each(docs).collect()) == list(range(0, 40, 2))


def test_print_links_against_brute_force(spark, monkeypatch):
    """Wide prints that share a triple of a lane and differ in 38 bits or fewer are connected, others aren't, also in lists dealt as blocks."""
    rng = random.Random(22)
    values = []
    for _ in range(30):
        x = rng.getrandbits(256)
        values += [x, *(x ^ sum(1 << b for b in rng.sample(range(256), n)) for n in (0, 4, 20, 38, 39, 60))]
    prints = [v.to_bytes(32, "big") for v in values]
    groups = [[8 * lane + i for i in g] for lane in range(4) for g in neardup.byte_groups()]
    triples = [{(*g, *(p[i] for i in g)) for g in groups} for p in prints]
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if triples[i] & triples[j] and (values[i] ^ values[j]).bit_count() <= 38:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "key long, fp binary")
    stars = {r.node: r.root for r in components(neardup.print_links(frame)).collect()}
    want = [find(i) for i in range(len(values))]
    assert [stars.get(i, i) for i in range(len(values))] == want and 60 < len(set(want)) < 150
    monkeypatch.setattr(neardup, "BLOCK", 3)
    edges = neardup.print_links(frame).collect()
    assert edges and all(want[r.a] == want[r.b] for r in edges)
    assert all(len({r.key for r in rows}) <= 7 for rows in by_part(neardup._by_prints(neardup.print_links(frame)).collect()).values())


def by_part(rows):
    found = {}
    for r in rows:
        found.setdefault(r.part, []).append(r)
    return found


def test_prints_of_similar_texts_meet():
    """Most pairs with J of 0.9 share a triple and differ in 38 bits or fewer; the others are the exact way's."""
    rng = np.random.default_rng(23)
    groups = [[8 * lane + i for i in g] for lane in range(4) for g in neardup.byte_groups()]
    met = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 380)
        b = np.concatenate([a[20:], rng.integers(0, 1 << 62, 20)])
        x, y = (np.frombuffer(neardup.signature(v)[:32], np.uint8) for v in (a, b))
        met += np.bitwise_count(x ^ y).sum() <= 38 and any((x[g] == y[g]).all() for g in groups)
    assert met > 100
