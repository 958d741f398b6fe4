import dataclasses
import random

import numpy as np
import public_tokenizers
import sentencepiece

from quadrille.llm import pieces

from . import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.Vocabulary.load(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    parts = [" ", "\n", "a", "the", "é", "1", "!", " ", "  ", "\n", "▁", "ﬁ", "Ａ", "\t", "in", "er", "\x00", "😀", "<s>", "foo"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [r[1] for r in cases.rows()] + ["ab" * 1500 + " c"]


def test_encoding_is_the_librarys(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows + [(None, "null id"), rows[7]], "doc_id long, text string")
    for hot in (3, 100_000):
        got = pieces.encode(docs, MODEL, hot=hot).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            text = "null id" if r.doc_id is None else rows[r.doc_id][1]
            assert r.ids == LIBRARY.encode(text or ""), text
            assert r.round_trip == (LIBRARY.decode(r.ids) == (text or "")) or "\x00" in (text or "")


def test_decoding(spark):
    rows = [(i, LIBRARY.encode(t or ""), t) for i, t in enumerate(texts())]
    got = pieces.decode(spark.createDataFrame([r[:2] for r in rows] + [(None, None)], "doc_id long, ids array<int>"), MODEL).collect()
    for r in got:
        assert r.text == (None if r.doc_id is None else (rows[r.doc_id][2] or "").replace("▁", " "))


SCORE, ID = {p: s for p, _, s in MODEL.pieces}, {p: i for p, i, _ in MODEL.pieces}
WORST = min(SCORE.values()) - 10
LONGEST = MODEL.longest


def words(cuts, text):
    return [p.decode() for p in cuts.parts([text])[0]]


def best(chunk, model):
    """Least cost from the start, place by place; the longer piece wins a tie."""
    score, ids, worst = SCORE, ID, WORST
    states = [(0.0, None, 0)]
    for e in range(1, len(chunk) + 1):
        edges = [(states[s][0] - score.get(chunk[s:e], worst), s) for s in range(max(0, e - LONGEST), e) if chunk[s:e] in score or e - s == 1]
        states.append((*min(edges), 0))
    out, e = [], len(chunk)
    while e:
        s = states[e][1]
        p = chunk[s:e]
        out.append([ids[p]] if p in ids else [model.byte_ids[b] for b in p.encode()])
        e = s
    return [i for x in reversed(out) for i in x]


def test_viterbi_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:250] + ["the" * 400 + " end"])]
    unigram = dataclasses.replace(MODEL, unigram=True)
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), unigram).collect()
    cuts = pieces.Cuts.of(unigram)
    for r in got:
        assert r.ids == [i for part in words(cuts, rows[r.doc_id][1]) for i in best(part, unigram)]


def test_cuts_cross_no_piece():
    """Pieces put side by side are cut only where no piece spans, and parts make up the text."""
    rng, cuts = random.Random(5), pieces.Cuts.of(MODEL)
    names = [p for p, _, _ in MODEL.pieces]
    spanning = {p for p in names if len(p) > 1}
    for _ in range(300):
        text = "".join(rng.choices(names, k=12)).replace("▁", " ")
        parts = words(cuts, text)
        whole = "▁" + text.replace(" ", "▁")
        assert "".join(parts) == whole
        at = 0
        for part in parts[:-1]:
            at += len(part)
            assert not any(whole[s:e] in spanning for s in range(max(0, at - LONGEST), at) for e in range(at + 1, min(len(whole), s + LONGEST) + 1))


def test_words_of_200_000_letters(spark):
    rng = random.Random(9)
    long = "".join(rng.choices(["the", "in", "er", "ou", "a"], k=200_000))[:200_000]
    docs = spark.createDataFrame([(0, long), (1, "z" * 200_000)], "doc_id long, text string")
    for r in pieces.encode(docs, MODEL).collect():
        assert r.round_trip and r.ids == LIBRARY.encode(docs.where(f"doc_id = {r.doc_id}").first().text)
    unigram = dataclasses.replace(MODEL, unigram=True)
    cuts = pieces.Cuts.of(unigram)
    for r in pieces.encode(docs, unigram).collect():
        text = long if r.doc_id == 0 else "z" * 200_000
        assert r.round_trip and r.ids == [i for part in words(cuts, text) for i in best(part, unigram)]


def test_a_unigram_models_library(spark, tmp_path):
    """A unigram model of hand-written pieces gives the ids of the library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    kind = pb.ModelProto.SentencePiece
    words = ["▁", "▁th", "▁the", "e", "h", "t", "he", "in", "i", "n", "▁in", "er", "r", "a", "▁a", "foo", "f", "o", "oo", "1", "ﬁ"]
    others = [p for p in model.pieces if p.type not in (kind.NORMAL, kind.USER_DEFINED)]
    del model.pieces[:]
    for p in others:
        model.pieces.add().CopyFrom(p)
    for k, w in enumerate(words):
        model.pieces.add(piece=w, score=-1.0 - (7 * k % 11) / 3, type=kind.NORMAL)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    own, library = pieces.Vocabulary.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert own.unigram
    rows = list(enumerate(texts()[:300]))
    for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), own).collect():
        assert r.ids == library.encode(rows[r.doc_id][1] or ""), rows[r.doc_id][1]


def test_empty(spark):
    assert pieces.encode(cases.empty(spark), MODEL).count() == 0
    assert all(r.ids is not None for r in pieces.encode(cases.table(spark), MODEL).collect())


def test_coded_parts_are_the_parts():
    """Parts by number are those of ``parts``, also for empty, null and wide texts; a text's own parts come in their order."""
    cuts = pieces.Cuts.of(MODEL)
    for some in (texts(), [], ["", None], [None, "a b", "", "é😀 a b a b", ""]):
        bounds, words, index = cuts.coded(some)
        assert len(set(words)) == len(words)
        assert [[words[i] for i in index[a:b]] for a, b in zip(bounds, bounds[1:])] == cuts.parts(some)
    some = ["x y x z", "", "z y"]
    bounds, words, index = cuts.coded(some)
    row, part = pieces._own(bounds, words, index, np.array([w != words[index[1]] for w in words]))
    own = [[words[i] for i in part[row == k]] for k in range(3)]
    assert own == [sorted({w for w in p if w != words[index[1]]}) for p in cuts.parts(some)]


def test_workers_let_words_go(monkeypatch):
    """A worker without a task here keeps no words."""
    import pickle
    import time
    import types

    import zstandard

    monkeypatch.setattr(pieces, "IDLE", 0.2)
    blob = zstandard.ZstdCompressor().compress(pickle.dumps({b"a": b"b"}))
    shared = pieces._shared(types.SimpleNamespace(value=[blob]), 1)
    assert pieces._held(shared) == {b"a": b"b"} and pieces._unpacked.cache_info().currsize == 1
    time.sleep(0.6)
    assert pieces._unpacked.cache_info().currsize == 0


def test_words_are_counted_by_number(monkeypatch):
    """Words are counted and sent on by their numbers; texts aren't split into lists of parts."""
    import pyarrow as pa

    cuts, some = pieces.Cuts.of(MODEL), texts()
    want = {}
    for w in {w for p in cuts.parts(some) for w in p}:
        want[w.decode()] = 1
    monkeypatch.setattr(pieces.Cuts, "parts", None)
    batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["text"])
    found = [r for b in pieces._in_words([batch], cuts) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in found} == want and len(found) == len(want)
