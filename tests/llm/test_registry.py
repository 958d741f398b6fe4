"""The registered queries on whole tables, against brute force written for this test."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quadrille.llm import licenses, quality, registry, secrets, toxicity

from . import test_licenses, test_neardup, test_quality, test_secrets, test_substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark, rows):
    """Scores are those of the convolutions written out for each text; held-out labels teach nothing."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    net = toxicity.learn(docs, labels)
    same = toxicity.learn(docs, labels.where(~labels.doc_id.isin(sorted(held))))
    assert (net.table == same.table).all() and net.threshold == same.threshold

    def score(text):
        words = toxicity.words_of(text)
        vectors = [net.table[[zlib.crc32(p) % toxicity.BUCKETS for p in [w] + [(b"<" + w + b">")[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]]].mean(0) for w in words]
        vectors += [np.zeros(toxicity.DIM, np.float32)] * max(toxicity.WIDTHS)
        pooled, at = [], 0
        for w in toxicity.WIDTHS:
            places = range(len(words) + 1)
            pooled.append(np.max([sum(vectors[i + o] @ net.filters[at + o] for o in range(w)) for i in places], axis=0))
            at += w
        logit = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.shift
        return 1 / (1 + np.exp(-net.scale * float(logit)))

    got = result(spark, "op3_toxicity")
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - score(rows[r.doc_id].text)) < 1e-4
        assert r.held_out == (r.doc_id in held) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1


def test_op4(spark, rows):
    ids = sorted(rows)
    prints = [test_neardup.brute_print(rows[i].text) for i in ids]
    classes = test_neardup.brute_classes(ids, prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op4_simhash_dedup")}
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, classes)}


def test_op5(spark, rows):
    models = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in result(spark, "op5_secret_scan")}
    assert got.keys() == rows.keys()
    for i, r in got.items():
        base = test_secrets.brute(rows[i].text or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == sha(joined(base))
        both = sorted(base + models.spans(rows[i].text or "", base), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert r.spans == joined(both)


def test_op6(spark, rows):
    got = {r.doc_id: r for r in result(spark, "op6_license_scan")}
    assert got.keys() == rows.keys()
    for i, r in got.items():
        n, starts, labels = test_licenses.brute(rows[i].text)
        more = {m[0] for m in licenses.scan_text(rows[i].text)[3]}
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (n, len(starts), ",".join(labels), ",".join(sorted({*labels, *more})))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None)) and 0 <= r.score <= 1


def test_op7(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in result(spark, "op7_sentencepiece")}
    assert {i: (r.n_tokens, r.ids) for i, r in got.items()} == {i: (len(x := library.encode(r.text or "")), x) for i, r in rows.items()}
    assert all(r.round_trip for r in got.values())


def test_op8(spark, rows):
    plain = Tokenizer.from_file(registry.vocabulary_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i in sorted(rows):
        ids = [*plain.encode(rows[i].text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op8_token_shards")) == want


def test_op9(spark, rows):
    want = {i: (n, gone, sha(kept)) for i, n, gone, kept in test_substrings.brute([(i, r.text) for i, r in rows.items()])}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, "op9_substring_dedup")} == want


def rejects(rules, row):
    return any(all(t.holds(row) for t in rule) for rule in rules)


def test_op10(spark, rows):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.learn_rules(quality.labelled(docs, labels))
    features = {r.doc_id: r.asDict() for r in quality.statistics(docs).collect()}
    got = result(spark, "op10_quality_rules")
    assert len(got) == len(rows)
    for r in got:
        b = test_quality.brute(rows[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert r.kept == (not r.base_failed and not rejects(rules, features[r.doc_id]))
