import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quadrille.llm import tokenfile
from quadrille.llm.common import new_path
from quadrille.llm.eliasfano import EliasFano

from . import cases

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 10**15), (7, 3), (3000, 10**6), (5000, 2)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
    ef, _ = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert (ef.values() == values).all()
    assert all(ef.select(i) == int(values[i]) for i in range(0, n, 7))
    for a in range(0, n, 701):
        assert (ef.values(a, a + 600) == values[a : a + 600]).all()
    if n == 3000:
        assert len(ef.to_bytes()) * 8 / n < 2 + np.log2(top / n) + 1


def test_pieces_give_the_whole_texts_ids():
    rng = random.Random(2)
    parts = [" ", "\n", "\t", "a", "b", "é", "1", "!", "'s", "\x1c", "　", "<|endoftext|>", "ab cd", "\x85", "  ", "x\ny", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    encoder, plain = tokenfile.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_new_pieces_go_to_the_library_in_short_texts():
    """However many new pieces there are, a text made of them is short, and their ids are the library's."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeé1", k=rng.randint(1, 9))) for _ in range(3000))
    encoder, plain, lines = tokenfile.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []

    class Library:
        def encode_batch_fast(self, texts, **options):
            lines.extend(t.count("\n") + 1 for t in texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Library()
    (ids,) = encoder.encode([text])
    assert np.frombuffer(ids, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(lines) > 1000 and max(lines) <= 64


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_one_id_is_not_one_task(spark):
    docs = spark.range(3000).selectExpr("if(id < 2000, 7, id) as doc_id", "if(id < 1000, 'same text', concat('text ', id)) as text")
    path, coalesce = new_path(spark, "test"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        manifest = tokenfile.write_shards(docs.repartition(6), path, VOCABULARY)
    finally:
        spark.conf.unset(coalesce)
    assert max(r.n_docs for r in manifest.collect()) < 1500
    got = tokenfile.read_shards(spark, path, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([7] * 2000 + list(range(2000, 3000)))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_round_trip(spark):
    rows = [r[:2] for r in cases.rows()]
    plain = Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1] or ""))):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = new_path(spark, "test")
    manifest = tokenfile.write_shards(cases.table(spark), path, VOCABULARY)
    got = [tuple(r) for r in tokenfile.read_shards(spark, path, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    for r in manifest.collect():
        shard = tokenfile.Shard(path, r.file)
        whole = [(d, ids.tolist()) for d, _, ids in shard.scan()]
        assert whole == [(shard.doc_id(i), shard.ids(i).tolist()) for i in range(shard.n_docs)]


def test_empty(spark):
    assert tokenfile.token_digest(cases.empty(spark), VOCABULARY).count() == 0
