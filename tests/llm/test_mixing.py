import collections
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as M
from quire.llm import pretoken
from quire.llm.common import whole_text


@pytest.fixture
def dims(spark):
    return {"source": F.col("source"), "lang": F.col("lang")}


def test_rake_meets_feasible_targets():
    keys = [(a, b) for a in "xyz" for b in "pq"]
    tokens = np.array([50, 10, 30, 40, 20, 60.0])
    goals = [{"x": 0.3, "y": 0.4, "z": 0.3}, {"p": 0.5, "q": 0.5}]
    w = M.rake(keys, tokens, goals, keep=0.4)
    for d, goal in enumerate(goals):
        for v, want in goal.items():
            assert sum(x for k, x in zip(keys, w) if k[d] == v) == pytest.approx(want, abs=1e-6)
    assert (w <= tokens / tokens.sum() / 0.4 + 1e-12).all()


def test_rake_is_bounded():
    keys = [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")]
    tokens = np.array([90, 1, 5, 4.0])
    w = M.rake(keys, tokens, [{"a": 0.1, "b": 0.9}, {"p": 0.1, "q": 0.9}], keep=0.8)
    share = tokens / 100
    assert (w <= share / 0.8 + 1e-12).all() and (w >= M.LEAST * share - 1e-12).all()


def test_attainable():
    assert M.attainable({"a": 0.9, "b": 0.1, "gone": 0.5}, {"a": 0.5, "b": 0.9}) == pytest.approx({"a": 0.5, "b": 0.5})
    assert M.attainable({}, {"a": 1.0}) == {}


def docs_of(make_docs):
    texts = ["word " * (10 + i % 50) for i in range(600)]
    docs = make_docs(texts)
    return docs.withColumns({"source": F.when(F.col("doc_id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)), "lang": F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")})


@pytest.mark.parametrize("targets", [None, {"source": {"big": 0.2, "s1": 0.5, "s3": 0.2, "none": 0.1}}])
def test_frames_equal_arrays(make_docs, targets):
    rows = docs_of(make_docs).select(F.col("source"), F.col("lang"), F.length("text").alias("__weight"))
    a = {(r.source, r.lang): (r.w, r.p) for r in M.calibrated(rows, ["source", "lang"], targets).collect()}
    b = {(r.source, r.lang): (r.w, r.p) for r in M.calibrated(rows, ["source", "lang"], targets, limit=3).collect()}  # more cells, and values, than the limit
    assert b.keys() == a.keys()
    assert all(b[k] == pytest.approx(a[k], abs=1e-6) for k in a)


def simply(rows, dims, keep):
    """Probabilities of (values, weight) rows by plain dictionaries."""
    cell = collections.Counter()
    for values, weight in rows:
        cell[values] += weight
    total = sum(cell.values())
    have = [collections.Counter() for _ in dims]
    for values, t in cell.items():
        for d, v in enumerate(values):
            have[d][v] += t / total
    goals = []
    for shares in have:
        want, full = {v: x**0.5 for v, x in shares.items()}, {}
        while True:
            rest = sum(x for v, x in want.items() if v not in full)
            now = {v: full.get(v, want[v] / rest * (1 - sum(full.values())) if rest else 0) for v in want}
            over = {v: shares[v] / keep for v in want if v not in full and now[v] > shares[v] / keep}
            if not over:
                break
            full |= over
        goals.append(now)
    w = {c: t / total for c, t in cell.items()}
    for _ in range(M.ROUNDS):
        last = dict(w)
        for d, goal in enumerate(goals):
            sums = collections.Counter()
            for c, x in w.items():
                sums[c[d]] += x
            w = {c: min(max(x * goal[c[d]] / sums[c[d]], M.LEAST * cell[c] / total), cell[c] / total / keep) for c, x in w.items()}
        if max(abs(w[c] - last[c]) for c in w) <= M.CLOSE:
            break
    return {c: min(1.0, w[c] * keep * total / cell[c]) for c in w}, goals, w


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    from quire.llm import queries

    kinds = ["plain words only here and there ", "call 555-1234 or ann@x.org ", "x = f(); y = {g}; ", "| a | b ", "12345 678 "]
    rows = [(i, kinds[i * i % 5] * (1 + i % 37), ["en", "de", None][i % 7 % 3], f"src{i % 4 if i % 2 else 0}", 1) for i in range(500)] + [(900, None, "en", "src1", 0), (901, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_source_mixing(spark, str(tmp_path)).collect()}
    tokenizer = pretoken.load(public_tokenizers.path(M.TOKENIZER))

    def topic(text):
        best = max((len(re.findall(p, re.sub(M.TOPICS["contact"], " ", text) if n == "numbers" else text, re.ASCII)), n) for n, p in M.TOPICS.items())
        return best[1] if best[0] >= M.TOPIC_SHARE * max(1, len(text.split())) else M.NO_TOPIC

    facts = {i: ((source, lang, topic(text or "")), max(1, len(tokenizer.encode(text or "", add_special_tokens=False).ids))) for i, text, lang, source, _ in rows}
    p, goals, w = simply(facts.values(), ("source", "lang", "topic"), M.KEEP)
    draws = {r.doc_id: r.x for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", M.draw("doc_id", "text", 9).alias("x")).collect()}
    assert got.keys() == facts.keys()
    for i, (values, weight) in facts.items():
        r = got[i]
        assert ((r.source, r.lang, r.topic), r.weight) == (values, weight)
        assert r.probability == pytest.approx(p[values], abs=1e-6) and r.kept == (draws[i] < r.probability)
    # every marginal within a hundredth of its target
    for d, goal in enumerate(goals):
        for v, want in goal.items():
            assert abs(sum(x for c, x in w.items() if c[d] == v) - want) <= 0.01


def test_clashing_columns(odd_docs, dims):
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("weight", "probability", "kept", "topic", "p", "w", "tokens", "goal", "value")})
    assert M.decisions(clash, dims).count() == clash.count()
    assert M.mixed(clash, dims).columns == clash.columns


def test_decisions_and_rows_agree(make_docs, dims):
    docs = docs_of(make_docs)
    rows = M.decisions(docs, dims).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in M.mixed(docs, dims).collect()} == kept
    assert all(0 <= r.probability <= 1 for r in rows)
    weight = sum(r.weight for r in rows)
    assert sum(r.weight * r.probability for r in rows) <= M.KEEP * weight * 1.001
    assert sum(r.weight for r in rows if r.kept) == pytest.approx(sum(r.weight * r.probability for r in rows), rel=0.12)
    by = collections.Counter()
    for r in rows:
        by[r.source] += r.weight * r.probability
    assert by["big"] / sum(by.values()) < sum(r.weight for r in rows if r.source == "big") / weight


def test_odd_rows(odd_docs, dims):
    rows = M.decisions(odd_docs, dims | {"topic": M.topic_of(F.coalesce("text", F.lit("")))}).collect()
    assert len(rows) == odd_docs.count() and all(r.weight >= 1 for r in rows)
    pairs = collections.defaultdict(set)
    for r in rows:
        pairs[(r.doc_id, r.weight, r.source, r.lang)].add(r.kept)
    assert all(len(x) == 1 for k, x in pairs.items() if k[0] is not None)
    assert M.decisions(odd_docs.limit(0), dims).collect() == [] and M.mixed(odd_docs.limit(0), dims).collect() == []


def test_given_targets(make_docs, dims):
    docs = docs_of(make_docs)
    rows = M.decisions(docs, dims, {"source": {"s0": 1.0}}).collect()
    assert {r.source for r in rows if r.kept} == {"s0"}


def test_topics(spark):
    texts = {"code": "{a;b;c=1;}", "contact": "mail a@b.c now", "listing": "| a | b | c |", "numbers": "12345 67", "prose": "plain words only"}
    rows = spark.createDataFrame(list(texts.items()), "want string, text string")
    assert all(r.want == r.got for r in rows.select("want", M.topic_of(F.col("text")).alias("got")).collect())


def test_weight_is_the_tokenizers_count(spark):
    texts = ["plain words only", "1234567890 " * 20, "if (a[i] != b) { c += 1; }", "\u6f22\u5b57\u3068\u304b\u306a" * 9, "\u00e9\u00e0\u00fc\u00f1 " * 12, "x" * 400, "<|endoftext|> a", "", " "]
    tokenizer = pretoken.load(public_tokenizers.path(M.TOKENIZER))
    rows = spark.createDataFrame([(x, max(1, len(tokenizer.encode(x, add_special_tokens=False).ids))) for x in texts], "text string, want long")
    got = rows.select("text", "want", M.token_weight(F.col("text")).alias("got")).collect()
    assert len(got) == len(texts) and all(r.want == r.got for r in got)
    assert any(r.want != max(1, len(r.text) // 4) for r in got)


def test_topics_of_phones_emails_and_code(spark):
    texts = {
        "Ann (555) 123-4567\nBob (555) 765-4321": "contact",
        "call 555-1234 or 555 9876 today": "contact",
        "write to ann.b+c@example.org or to bob@example.com": "contact",
        "one address among many words: ann@example.org " + "and then prose goes on " * 2: "prose",
        "@cache def f() return g() -> h() std::x @wraps": "code",
        "see https://example.org/a and www.example.org for more": "contact",
        "1 22 333 4444 55555 in 6 rows": "numbers",
        "meet @ noon or @ six, we said": "prose",
    }
    rows = spark.createDataFrame(list(texts.items()), "text string, want string")
    assert [(r.text, r.got) for r in rows.select("text", M.topic_of(F.col("text")).alias("got")).collect()] == list(texts.items())


def test_marks_equal_the_patterns(spark):
    texts = ["a@b.com.x@d.e", "123 4567abc@x.y", "123-4567@x.y", "www.x@y.z", "a@b-c@d.e", "a@b.c@d.e", "https://u@h.com", "(123)a@b.c", "é@b.c ü.a@b.c", "((123)) 1234 5678 123-45678-9012", "<a></a> ->-> ::: ()() >", "|| # ** 12 3\x854\u00a05", "...@a.b --@a.b _@_._", "a.b-c+d@e.f-g@h.i", ""]
    columns = [F.regexp_count(F.regexp_replace("text", M.TOPICS["contact"], " ") if name == "numbers" else F.col("text"), F.lit(mark)).alias(name) for name, mark in M.TOPICS.items()]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", *columns, F.regexp_count("text", F.lit(r"\S+")).alias("words")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert M.marks(r.text) == {name: r[name] for name in M.TOPICS}, r.text
        assert len(r.text.encode().split()) == r.words
    assert len(M.marks("a" * 200_000 + " @")) == len(M.TOPICS)  # in time that grows with the text, not its square


def test_marks_are_counted_by_bytes(monkeypatch):
    texts = ["12 3\x854\u00a05 \u0663", "||# * 9%", "a\tb\x0bc\x1cd\x85e\u00a0f\n", "1", "é1é|é", "\ud800 7", ""]
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        assert M.runs(raw, "words") == len(raw.split())
        assert M.runs(raw, "numbers") == len(re.findall(M.TOPICS["numbers"], text, re.ASCII)) and M.runs(raw, "listing") == len(re.findall(M.TOPICS["listing"], text))
    phones = ["(555)", "555-1234", "555 1234", "x9876-54321", "1 234 5678"]
    assert all(M.marks(x)["contact"] == len(re.findall(M.TOPICS["contact"], x, re.ASCII)) == 1 for x in phones)
    monkeypatch.setattr(M, "PHONE", None)  # texts without a contact aren't searched by a pattern
    assert M.marks("12 plain | words 345; 55-1234")["contact"] == 0


def test_mixed_and_decisions_agree_on_topics(make_docs, dims):
    docs = make_docs(["call 555-1234 now", "plain words " * 9, "x = f(); y = g();", "| a | b |"] * 60).withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    dims = dims | {"topic": M.topic_of(whole_text("text"))}
    kept = {r.doc_id for r in M.decisions(docs, dims).collect() if r.kept}
    assert {r.doc_id for r in M.mixed(docs, dims).collect()} == kept
