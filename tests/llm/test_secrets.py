import hashlib
import re

from pyspark.sql import functions as F

from quire.llm import secrets as S

A = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "AKIA" + "Z9" * 8
HEX = "0123456789abcdef" * 3
TEXTS = [
    None,
    "",
    "token = 'abc'",
    f'token = "{HEX}" and {HEX}',
    f"Password:hunter2hunter2 {KEY} AKIASHORT",
    "secret: token=abcdefgh password: token : abcdefghij",
    "😀 api_key='x1y2z3x1y2z3x1y2z3' ÄÖ " + KEY,
    "AKIA" * 5,
    "f" * 31 + " " + "F" * 40 + " " + "f" * 32,
    "prefix " * 3000 + f"passwd={'Ab3Cd9' * 5}",
    "token=changeme1234changeme1234",
    "token=changeme1234changeme1234",
    "a token=changeme1234changeme1234 b",
    f"token={'aaaaaaaaaa' * 3}",
    "ſecret=abcdefghijkl",
]


def base(text):
    spans = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans(make_docs):
    docs = make_docs(TEXTS).unionByName(make_docs([TEXTS[3]], 3))
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.scan(docs, F.col("source"), F.col("lang")).collect())
    want = []
    for r in docs.collect():
        spans = base(r.text or "")
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((r.doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)


def test_ownership_separates(make_docs):
    rows = {r.doc_id: r for r in S.scan(make_docs(TEXTS), F.col("source"), F.col("lang")).collect()}
    # three documents of three sources share a value, another stands in one
    assert [rows[i].n_example for i in (10, 11, 12)] == [1, 1, 1] and rows[10].n_live == 0
    assert rows[3].n_live == 2 and rows[13].n_live == rows[13].n_example == 0
    at = TEXTS[12].index("changeme")
    assert f"example:{at}:{at + 24}" in rows[12].spans.split(",")


def test_redaction(make_docs):
    docs = make_docs(TEXTS)
    got = {r.doc_id: r.text for r in S.redact(docs, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(TEXTS) and got[0] is None and got[1] == "" and got[2] == TEXTS[2]
    assert got[3] == 'token = "[SECRET]" and [SECRET]'
    assert HEX not in got[3] and KEY not in got[4] and got[10] == TEXTS[10]
    assert got[6] == "😀 api_key='[SECRET]' ÄÖ [SECRET]" and got[9].endswith("passwd=[SECRET]")


def test_empty_and_null_owner(make_docs):
    docs = make_docs(TEXTS[3:4]).withColumn("source", F.lit(None).cast("string"))
    assert S.scan(docs, F.col("source"), F.col("source")).collect()[0].n_live == 2
    assert S.scan(docs.limit(0), F.col("source"), F.col("lang")).collect() == []
    clash = make_docs(TEXTS).withColumns({"spans": F.lit(1), "key": F.lit(2), "hash": F.lit(3), "owner": F.lit(4), "marks": F.lit(5)})
    assert S.redact(clash, F.col("source"), F.col("lang")).columns == clash.columns


def test_repositories_make_examples(spark):
    copied, own = "token=Zx81Kq02Lm93Pw74", "token=Qa1Ws2Ed3Rf4Tg5Y"
    rows = [(i, copied, "one owner", f"repo {i % S.EXAMPLE_REPOS}") for i in range(12)] + [(20 + i, own, "one owner", f"repo {i % 2}") for i in range(12)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string"), F.col("owner"), F.col("repo")).collect()}
    assert all(got[i].n_example == 1 and (got[i].most_owners, got[i].most_repos) == (1, S.EXAMPLE_REPOS) for i in range(12))
    assert all(got[20 + i].n_live == 1 and (got[20 + i].most_owners, got[20 + i].most_repos) == (1, 2) for i in range(12))


def test_owners_of_a_larger_corpus(make_docs):
    docs = make_docs(TEXTS)
    one = docs.filter("doc_id = 10")
    assert S.redact(one, F.col("source"), F.col("lang")).collect()[0].text == "token=[SECRET]"
    assert S.redact(one, F.col("source"), F.col("lang"), corpus=docs).collect()[0].text == TEXTS[10]


def test_odd_rows_and_clashing_columns(odd_docs):
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("spans", "key", "hits", "hash", "owner", "repo", "kind", "start", "n_owners", "all", "live")})
    rows = S.scan(clash, F.col("source"), F.col("lang")).collect()
    assert len(rows) == odd_docs.count() and all(r.n_assign == r.n_hex == r.n_live == 0 and r.spans == "" for r in rows)
    assert S.redact(clash, F.col("source"), F.col("lang")).count() == len(rows)


def test_many_matches_in_one_long_text(make_docs):
    text = " ".join(f"token=x{i:07d}Ab{i:032x}" for i in range(1, 4001)) + " end"
    docs = make_docs([text, None, text]).unionByName(make_docs([text], 0))
    rows = S.scan(docs, F.col("source"), F.col("lang")).collect()
    spans = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base(text))
    assert [r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() for r in rows].count(True) == 3
    got = {r.doc_id: r.text for r in S.redact(docs, F.col("source"), F.col("lang")).collect()}
    assert got[1] is None and got[2] == " ".join(["token=[SECRET]"] * 4000) + " end"
