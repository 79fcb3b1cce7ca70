import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import pretoken, tokens

WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def tricky():
    rng = random.Random(5)
    yield from map(chr, range(pretoken.SAFE))
    yield from ("a" + chr(c) + "b 1" + chr(c) + "2 ." + chr(c) for c in range(pretoken.SAFE))
    parts = ["'s", "'T", "'LL", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "A", "İ", "ªº", "²¼", "9", "_", "<|endoftext|>", "<|STARTOFTEXT|>", "the", " and", "’", "中", "\x00"]
    yield from ("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_equal_library(path):
    counter, library = tokens.Counter(path, tokens.prove(path)), Tokenizer.from_file(path)
    for text in tricky():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_ids_equal_library():
    import numpy as np

    encoder, library = pretoken.BytePairIds(BYTE), Tokenizer.from_file(BYTE)
    for text in tricky():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memo_that_starts_anew(monkeypatch):
    monkeypatch.setattr(pretoken, "MEMO", 4)
    monkeypatch.setattr(pretoken, "SEGMENT", 20)
    encoder, library = pretoken.BytePairIds(BYTE), Tokenizer.from_file(BYTE)
    counter = tokens.Counter(WORD, frozenset())
    words = Tokenizer.from_file(WORD)
    for text in ("a b c d e f g h i j k l m", "one two three four five six seven eight nine", "a zz yy xx ww"):
        assert len(encoder.encode(text)) == 4 * len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids)


def test_unsafe_runs_go_to_the_library_alone():
    rng = random.Random(6)
    parts = ["the", "river's", "“quoted”", "dash—dash", "текст", "中文字", "e\u0301", "ΑΣ", " ", "\n", "12", "😀", "ok.", "ﬁ", "İ", "\u200d"]
    counters = [(tokens.Counter(p, tokens.prove(p)), Tokenizer.from_file(p)) for p in (WORD, BYTE)]
    encoder = pretoken.BytePairIds(BYTE)
    for _ in range(1500):
        text = "".join(x + rng.choice([" ", " ", "", "  "]) for x in rng.choices(parts, k=rng.randint(1, 15)))
        for counter, library in counters:
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
        assert len(encoder.encode(text)) == 4 * len(counters[1][1].encode(text, add_special_tokens=False).ids), repr(text)
    counter = counters[0][0]
    n = counter.count("the river and “the” window " * 50)
    assert counter.shortcut == 200 < n  # every safe word


def test_three_million_characters():
    text = ("the river, the window; 12 " * 60 + "“curly” ") * 2000
    assert len(text) > 3_000_000 and len(list(pretoken.segments(text))) >= 3
    counter, library = tokens.Counter(WORD, tokens.prove(WORD)), Tokenizer.from_file(WORD)
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    encoder, library = pretoken.BytePairIds(BYTE), Tokenizer.from_file(BYTE)
    assert len(encoder.encode(text)) == 4 * len(library.encode(text, add_special_tokens=False).ids)
    assert encoder.encode(text.replace("“", "'").replace("”", "'")) != b""


def test_clashing_columns(odd_docs):
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("n_bytes", "n_tokens", "over_limit", "n_shortcut", "__text", "__bytes")})
    assert sorted(map(tuple, tokens.token_counts(clash, WORD).collect()), key=str) == sorted(map(tuple, tokens.token_counts(odd_docs, WORD).collect()), key=str)


def test_proof_is_sound():
    library, whole = Tokenizer.from_file(WORD), tokens.prove(WORD)
    assert len(whole) > 30000
    for text in sorted(whole)[::50]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_odd_rows(odd_docs, path):
    if path == PIECE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = sorted((tuple(r)[:4] for r in tokens.token_counts(odd_docs, path, limit=100).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 100) for r in odd_docs.collect()), key=str)
    assert got == want


def test_empty_table(odd_docs):
    assert tokens.token_counts(odd_docs.limit(0), WORD).collect() == []
