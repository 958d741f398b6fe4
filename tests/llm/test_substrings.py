import random

from quadrille.llm import substrings

from . import cases


def brute(rows):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - 19):
            k, at = tuple(words[s : s + 20]), (2**63 - 1 if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - 19):
            if first[tuple(words[s : s + 20])] < (2**63 - 1 if i is None else i, s):
                gone.update(range(s, s + 20))
        out.append((i, len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode()))
    return sorted(out, key=str)


def check(spark, rows, docs):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_cases(spark):
    check(spark, [r[:2] for r in cases.rows()], cases.table(spark))
    assert substrings.without_repeats(cases.empty(spark)).count() == 0


def test_passages_and_periods(spark, monkeypatch):
    """Passages shared between and within documents, periodic texts, and chunks that part documents."""
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijk")
    passages = [[word() for _ in range(n)] for n in (20, 21, 35, 60)]
    rows = []
    for i in rng.sample(range(1000), 150):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 30))] + rng.choice(passages)
        if i % 7 == 0:
            words += [word() for _ in range(rng.randint(1, 5))] * 30
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_a_window_twice_raises_its_counters_twice():
    period = [b"a", b"b", b"c"] * 9
    for words in (period, [b"x"] * 21, [b"x"] * 20 + [b"y"] + [b"x"] * 20):
        for row in substrings.Chunk([(0, 0, words)]).sketch():
            assert len(row) >= 2
