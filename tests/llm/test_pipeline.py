import zlib
from collections import Counter
from hashlib import md5
from math import exp

import pytest
import sentencepiece

from quadrille.llm import quality, registry, secrets

from . import cases, test_quality, test_registry

SF = "/root/testdata/sf0.001"


def draw(*parts):
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def representatives(texts):
    """The smallest id of each group of texts linked by J >= 0.8 of their sets of five-word shingles; texts: id -> text."""
    sets = {}
    for i, t in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def mixed(rows):
    """Copies of each id by the distribution function of its source's rate, written out."""
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text or "") + 1
    weight = {s: registry.WEIGHTS.get(s, 1.0) for s in size}
    times = Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source]
        u, p, c, k = draw(0, r.doc_id) / 2**52, exp(-rate), exp(-rate), 0
        while c <= u and k < 200:
            k += 1
            p *= rate / k
            c += p
        times[r.doc_id] = k
    return +times


def test_every_stage_against_brute_force(spark):
    """Each stage's rows are reckoned from the rows of the stage before."""
    pipeline = pytest.importorskip("corpus_pipeline")
    library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary_path("piece_bpe_32k.model"))
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    columns, before = docs.columns, docs.collect()

    def ran(name):
        nonlocal docs
        docs = spark.createDataFrame(dict(pipeline.STAGES)[name](spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        return docs.collect()

    rules = quality.learn_rules(quality.labelled(docs, labels))
    features = {r.doc_id: r.asDict() for r in quality.statistics(docs).collect()}
    good = [r for r in before if (b := test_quality.brute(r.text))[0] >= 10 and 100 * b[4] <= 20 * b[0] and not test_registry.rejects(rules, features[r.doc_id])]
    now = ran("quality rules")
    assert sorted(now) == sorted(good) and 100 < len(now) < len(before)

    first = representatives({r.doc_id: r.text for r in now})
    before, now = now, ran("near-dedup")
    assert sorted(now) == sorted(r for r in before if r.doc_id in first) and len(now) < len(before)

    models = secrets.train(docs)
    before, now = now, ran("secret scan")
    want = {}
    for r in before:
        spans, text = secrets.base_spans(r.text or ""), r.text or ""
        for a, b in reversed(secrets._merged([(a, b) for _, a, b in spans + models.spans(text, spans)])):
            text = text[:a] + "[SECRET]" + text[b:]
        want[r.doc_id] = text
    assert {r.doc_id: r.text for r in now} == want and all(r.n_chars == len(r.text) for r in now if "[SECRET]" in r.text)

    times = mixed(now)
    before, now = now, ran("source mixing")
    assert Counter(r.doc_id for r in now) == times and {tuple(r) for r in now} <= {tuple(r) for r in before}

    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in now}
    assert Counter(r.doc_id for r in last) == times
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in last)
    crc = lambda rows: sorted(zlib.crc32(str(r).encode()) for r in rows)
    assert crc(last) == crc(pipeline.run(spark, SF).collect())


def test_stages_take_any_rows(spark):
    """Nulls, empty, repeated and long texts, extra columns; and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (cases.table(spark), cases.empty(spark)):
        for _, stage in pipeline.STAGES[:-1]:
            found = stage(spark, docs, SF)
            assert found.columns == docs.columns
            docs = spark.createDataFrame(found.collect(), docs.schema)
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
