import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quire.llm import langid as L

PIECES = P.path("piece_bpe_32k.model")
WORDS = {"en": "the of and with from that this river stone window".split(), "de": "der die das und nicht über straße fenster wasser".split(), "fr": "le la des avec pour être fenêtre rivière pierre".split()}


def brute(vocabulary, word, table, lang):
    text, index = L.MARK + word, {x: i for i, x in enumerate(vocabulary.names)}

    def rest(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, min(len(text), at + vocabulary.longest) + 1):
            p = table[index[text[at:end]], lang] if text[at:end] in index else 0.0
            total += (max(p, L.FLOOR) if end == at + 1 else p) * rest(end)
        return total

    return math.log(rest(0))


def test_forward_sums_all_segmentations():
    vocabulary, rng = L.pieces_of(PIECES), np.random.default_rng(1)
    table = rng.random((vocabulary.size + 1, 3))
    table[-1] = 0
    table /= table.sum(0)
    words = ["the", "straße", "qxz", "a", "éè中", "fenster"]
    got = L.word_scores(vocabulary, words, table)
    for (i, w), lang in itertools.product(enumerate(words), range(3)):
        assert got[i, lang] == pytest.approx(brute(vocabulary, w, table, lang))


def test_long_runs_equal_short_ones(monkeypatch):
    vocabulary, rng = L.pieces_of(PIECES), np.random.default_rng(3)
    table = rng.random((vocabulary.size + 1, 2))
    table[-1] = 0
    table /= table.sum(0)
    words = ["the", "straße", "wassermelone", "qxz中a", "a"]
    want = L.word_scores(vocabulary, words, table), L.expected_uses(vocabulary, words, np.array([1, 2, 3, 1, 5]), np.array([0, 1, 1, 0, 1]), table, 2), L.expected_uses(vocabulary, words, np.arange(5), np.array([0, 1, 1, 0, 1]), None, 2)
    monkeypatch.setattr(L, "LONG", 0)
    got = L.word_scores(vocabulary, words, table), L.expected_uses(vocabulary, words, np.array([1, 2, 3, 1, 5]), np.array([0, 1, 1, 0, 1]), table, 2), L.expected_uses(vocabulary, words, np.arange(5), np.array([0, 1, 1, 0, 1]), None, 2)
    for a, b in zip(got, want, strict=True):
        assert a[:-1] == pytest.approx(b[:-1], rel=1e-9, abs=1e-12) if len(a) > 5 else a == pytest.approx(b)


def test_a_run_of_many_letters_is_not_cut(make_docs):
    docs, _ = docs_of(make_docs)
    model = L.fit(docs, PIECES)
    text = "".join(WORDS["de"][k % 9] for k in range(3000))
    (lang, score), (shorter, _) = model.predict([text, text[:200]])
    assert lang == shorter == "de" and 0.99 <= score <= 1
    assert L.words_of(text) == [text.lower()] and np.isfinite(L.word_scores(L.pieces_of(PIECES), [text], model.table)).all()


def test_clashing_columns(make_docs):
    docs, _ = docs_of(make_docs, 60)
    clash = docs.withColumns({c: L.F.lit(1) for c in ("score", "lang_pred", "held_out", "word", "n", "__whole")})
    assert sorted(map(tuple, L.predictions(clash, PIECES).collect())) == sorted(map(tuple, L.predictions(docs, PIECES).collect()))


def test_expected_uses_sum_to_pieces():
    vocabulary = L.pieces_of(PIECES)
    table = np.full((vocabulary.size + 1, 1), 1 / vocabulary.size)
    table[-1] = 0
    uses = L.expected_uses(vocabulary, ["aa"], np.array([3]), np.array([0]), table, 1)
    index = {x: i for i, x in enumerate(vocabulary.names)}
    # every segmentation of the marked word covers its three characters, three times
    assert sum(uses[i, 0] * len(x) for x, i in index.items()) == pytest.approx(9)


def docs_of(make_docs, n=240):
    rng = random.Random(2)
    langs = [sorted(WORDS)[i % 3] for i in range(n)]
    texts = [" ".join(rng.choices(WORDS[x], k=rng.randint(3, 30))) for x in langs]
    docs = make_docs(texts)
    from pyspark.sql import functions as F

    return docs.withColumn("lang", F.element_at(F.array(*map(F.lit, sorted(WORDS))), (F.col("doc_id") % 3 + 1).cast("int"))), langs


def test_held_out_accuracy(make_docs):
    docs, langs = docs_of(make_docs)
    rows = L.predictions(docs, PIECES).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert held and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(make_docs, odd_docs):
    docs, _ = docs_of(make_docs, 60)
    model = L.fit(docs, PIECES)
    got = {r.doc_id: r for r in L.predicted(odd_docs, model, ["doc_id"]).collect()}
    for i in (0, 1, 2, 3):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(got[i].lang_pred in WORDS for i in (4, 9, 10, 11, 12))
    assert model.predict(["½ ² 12", "½a"])[0] == ("und", 0.0)
    assert L.predicted(odd_docs.limit(0), model, ["doc_id"]).collect() == []


def test_nothing_to_learn(odd_docs):
    from pyspark.sql import functions as F

    rows = L.predictions(odd_docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_memo_that_starts_anew(make_docs, monkeypatch):
    docs, langs = docs_of(make_docs, 60)
    model = L.fit(docs, PIECES)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    want = model.predict(texts)
    monkeypatch.setattr(L, "MEMO", 3)
    model.memo, model.rows = {}, model.rows[:0]
    assert [x for k in range(60) for x in model.predict([texts[k]])] == want
