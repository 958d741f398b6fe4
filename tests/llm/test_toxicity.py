import random
import zlib

import numpy as np

from quadrille.llm import toxicity

from . import cases


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = cases.prose(rng, rng.randint(20, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", "ic", "ish"]))
        rows.append((" ".join(words), ["en", "de"][i % 2], int(bad)))
    return rows


def test_held_out_accuracy_and_pooling():
    net = toxicity.train(corpus(400, 1), 0.25, epochs=4, steps=200)
    test = corpus(300, 2)
    scorer = toxicity.Scorer(net)
    p = scorer.scores([t for t, _, _ in test])
    y = np.array([r[2] for r in test])
    assert ((p >= 0.7) == (y == 1)).mean() > 0.97
    assert np.allclose(p[:40], np.concatenate([scorer.scores([t]) for t, _, _ in test[:40]]), atol=1e-6)
    # against each window by itself
    words = toxicity.words_of(test[0][0])
    v = toxicity.embed(net.table, words)[0]
    best = []
    for k, w in enumerate(toxicity.WIDTHS):
        c = sum(toxicity.WIDTHS[:k])
        padded = np.concatenate([v, np.zeros((w, toxicity.DIM), np.float32)])
        best.append(np.max([sum(padded[i + o] @ net.filters[c + o] for o in range(w)) for i in range(len(words) + 1)], axis=0))
    logit = float(net.logits((np.concatenate(best) + net.bias)[None])[0])
    assert abs(net.probability(np.array([logit]))[0] - p[0]) < 1e-4


def test_one_label_or_none():
    for rows in ([], [("a b", "en", 0)], [("a b", "en", 1)] * 3):
        p = toxicity.Scorer(toxicity.train(rows)).scores(["x y", "", None])
        assert len(set(p.round(9).tolist())) == 1 and 0 < p[0] < 1


def test_query(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0), (10, 1, 0), (12, 0, 0), (14, 1, 0), (17, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.learn(docs, labels)
    got = toxicity.scored(docs, net).select("*", toxicity.held_out().alias("held_out")).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert toxicity.scored(cases.empty(spark), net).count() == 0
    other = docs.withColumn("lang", docs.source).withColumn("doc_id", docs.doc_id + 1000)
    assert sorted(r.score for r in toxicity.scored(other, net).collect()) == sorted(r.score for r in got)


def test_long_words_are_seen_whole():
    word = "".join(chr(0x4E00 + i) for i in range(500))
    pieces = toxicity.words_of(word)
    whole = word.encode()
    assert max(map(len, pieces)) <= 64 and all(any(whole[i : i + 5] in p for p in pieces) for i in range(0, len(whole) - 4, 7))
    assert toxicity.words_of("plain words") == [b"plain", b"words"]
