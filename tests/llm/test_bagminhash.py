import collections
import random
import re

import numpy as np
import pytest

from quire.llm import bagminhash as M
from quire.llm import pretoken
from quire.llm.common import Stage
from quire.llm.components import components

W = re.compile(r"\w+")


def bag(text):
    w = W.findall((text or "").lower())
    k = min(M.WORDS, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or jaccard(bags[a], bags[b]) >= M.SIMILAR:
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(k)]
        ids = [x for x in members if x is not None]
        out.append((i, min(ids) if ids else None, len(members)))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(25)]
    texts += ["la " * n for n in (4, 5, 30, 36, 60, 61)]
    return texts


def test_unbiased_and_consistent():
    rng, errors = np.random.default_rng(0), []
    for _ in range(300):
        shingles = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        counts = rng.integers(1, 9, len(shingles))
        other = np.where(rng.random(len(shingles)) < 0.3, rng.integers(0, 12, len(shingles)), counts)
        a, b = (shingles, counts), (shingles[other > 0], other[other > 0])
        x, y = M.signatures([a, b])
        errors.append((x == y).mean() - M.similarity(a, b))
        assert (M.signatures([b])[0] == y).all()
    assert abs(np.mean(errors)) < 0.008


def test_similarity_is_exact():
    for a, b in (("a b c d e f g", "a b c d e f h"), ("x y", "x y"), ("", "a"), ("one two three four five " * 9, "one two three four five " * 10)):
        assert M.similarity(M.bag(M.words_of(a)), M.bag(M.words_of(b))) == pytest.approx(jaccard(bag(a), bag(b)))


def test_classes_equal_brute_force(spark, make_docs):
    texts = corpus() + [None, "", " ", "***", "***", "word", "Word!", "two words"]
    docs = make_docs(texts).unionByName(make_docs([texts[0], texts[1]], 0)).unionByName(make_docs([texts[3]]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    got = sorted(((r.doc_id, r.class_id, r.n_class) for r in M.near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_deduplicated_keeps_one_of_each(make_docs):
    texts = corpus(5) + [None, "", "***"]
    docs = make_docs(texts).unionByName(make_docs([texts[0]], 0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({c for _, c, _ in brute(rows)})
    assert sorted(r.doc_id for r in M.deduplicated(docs).collect()) == want


def test_empty(make_docs):
    docs = make_docs(["a"]).limit(0)
    assert M.near_duplicates(docs).collect() == [] and M.deduplicated(docs).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "test")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark, "test")).collect() == []


def test_hot_bucket_of_half_alike_texts(make_docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(120):  # each about 0.6 to 0.85 like the base, and like no other
        near = list(base)
        for at in rng.sample(range(len(near)), rng.randint(2, 7)):
            near[at] = word()
        texts.append(" ".join(near))
    docs = make_docs(texts)
    got = sorted((r.doc_id, r.class_id, r.n_class) for r in M.near_duplicates(docs).collect())
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_clashing_columns(make_docs):
    docs = make_docs(["one two three four five six", "one two three four five six", None]).withColumns({c: M.F.lit(1) for c in ("node", "bands", "bucket", "root", "fingerprint", "key", "n", "a", "b", "element", "__n")})
    assert sorted((r.doc_id, r.class_id) for r in M.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (2, 2)]
    assert M.deduplicated(docs.drop("__n")).columns == docs.drop("__n").columns


def test_long_texts_in_segments(monkeypatch):
    text = "Word other, third. " * 4000 + "end"
    whole = M.words_of(text)
    monkeypatch.setattr(M, "segments", lambda x: pretoken.segments(x, 1000))
    assert len(list(M.segments(text))) > 50 and (M.words_of(text) == whole).all()
