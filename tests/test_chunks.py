import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks as C
from quire.operators import glossary as G
from quire.operators import sinks as K
from quire.operators import validate as V
from quire.plans import workflow


def packed(blocks, soft, most, overhead, by_heading):
    """(chunk of each block) by a plain loop."""
    out, n, tokens, chunk = [], 0, 0, 0
    for text, heading in blocks:
        cost = max(1, len(text) // 4) + overhead
        if n and ((by_heading and heading is not None and heading <= 2) or tokens + cost > soft):
            chunk, n, tokens = chunk + 1, 0, 0
        out.append(chunk)
        n, tokens = n + 1, tokens + cost
        if tokens >= most:
            chunk, n, tokens = chunk + 1, 0, 0
    return out


@pytest.mark.parametrize(("overhead", "by_heading"), [(0, True), (2, True), (2, False)])
def test_chunk_numbers(spark, overhead, by_heading):
    rng, rows = random.Random(3), []
    for d in range(40):
        for p in range(rng.randint(1, 40)):
            rows.append((d, p, d * 100 + p, "x" * rng.choice([0, 3, 40, 80, 81, 200, 1200]), rng.choice([None, None, None, 1, 2, 3])))
    df = spark.createDataFrame(rows, "doc_id int, pos int, id int, text string, heading int")
    got = {(r.doc_id, r.pos): r for r in C.planned(df, 50, 100, overhead, by_heading).collect()}
    for d in range(40):
        own = [r for r in rows if r[0] == d]
        want = packed([(r[3], r[4]) for r in own], 50, 100, overhead, by_heading)
        chapter = None
        for r, chunk in zip(own, want):
            chapter = r[2] if r[4] is not None and r[4] <= 2 else chapter
            assert (got[d, r[1]].chunk, got[d, r[1]].chapter) == (chunk, chapter)


def test_batches(spark):
    rng = random.Random(4)
    texts = ["w " * rng.choice([5, 60, 240, 300, 900]) for _ in range(60)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "o int, i int, t string")
    got = [r.batch for r in C.batched(df, "o", "i", "t").orderBy("i").collect()]
    want, chars, batch, open_ = [], 0, 0, False
    for t in texts:
        small = len(t.split()) < 100 or len(t) < 500
        if open_ and (not small or chars + len(t) > 3000):
            batch, chars, open_ = batch + 1, 0, False
        want.append(batch)
        if small:
            chars, open_ = chars + len(t), True
        else:
            batch += 1
    assert got == want
    stats = C.batch_statistics(C.batched(df, "o", "i", "t"), "o").first()
    assert stats.n_chunks == 60 and stats.n_batches == len(set(want)) and stats.singles + stats.multis == stats.n_batches


def test_batch_parts(spark):
    rows = spark.createDataFrame([("a\n\nb\n\nc", [1, 1, 1]), ("abcdefghij", [1, 1, 2]), ("whole\n\ntext", [4]), ("xy", [0, 0])], "o string, s array<int>")
    assert [r[0] for r in rows.select(C.batch_parts(F.col("o"), F.col("s"))).collect()] == [["a", "b", "c"], ["ab", "cd", "efghij"], ["whole\n\ntext"], ["x", "y"]]


def test_cell_parts():
    text = "\n\n".join("p" * 40 for _ in range(20))
    parts = C.cell_parts(text, 25, 40)
    assert "\n\n".join(parts) == text and all(len(p) // 4 <= 25 for p in parts)
    assert C.cell_parts("short", 25, 40) == ["short"]
    long_ = "\n".join("l" * 30 for _ in range(20))
    assert "".join(C.cell_parts(long_, 25, 40)) == long_
    assert C.cell_parts(" " * 400, 25, 40) == [" " * 400]


def test_glossary(spark):
    rows = spark.createDataFrame([("The cat. THE dog; theory a.b axb é",)], "x string")
    terms = F.array(*(F.struct(F.lit(s).alias("source_term"), F.lit(t).alias("target_term"), F.lit(c).alias("case_sensitive")) for s, t, c in (("a.b", "$1\\", True), ("the", "T", False), ("é", "E", True))))
    assert rows.select(G.replaced(F.col("x"), terms)).first()[0] == "The cat. THE dog; theory $1\\ axb E"
    found = rows.select(V.missing_terms(F.col("x"), F.lit("T"), terms)).first()[0]
    assert [t.source_term for t in found] == ["a.b", "é"]


def test_provider_errors(spark):
    rows = spark.createDataFrame([(1, "s", "ok"), (2, "s", "bad")], "id int, system string, user string")

    def provider(system, user):
        if user == "bad":
            raise RuntimeError("no")
        return user.upper()

    assert sorted(map(tuple, G.provided(rows, provider).select("id", "target_text", "error_message").collect())) == [(1, "OK", None), (2, None, "no")]


def test_workflow_restores(spark):
    blocks = spark.createDataFrame([(1, 0, 10, "# Head", 1), (1, 1, 11, "The Agent runs `x = 1` at https://a.b/c", None), (1, 2, 12, "## Two", 2), (1, 3, 13, "no term", None)], "doc_id int, pos int, id int, text string, heading int")
    terms = F.array(F.struct(F.lit("Agent").alias("source_term"), F.lit("Wirkender").alias("target_term"), F.lit(True).alias("case_sensitive")))
    got = workflow.run(blocks, terms).orderBy("chunk").collect()
    assert [(r.status, r.chapter, r.block_ids) for r in got] == [("DONE", 10, [10, 11]), ("DONE", 12, [12, 13])]
    assert got[0].restored_text == "# Head\n\nThe Wirkender runs `x = 1` at https://a.b/c" and "`" not in got[0].target_text


def test_validation(spark):
    row = spark.createDataFrame([("a __LT_URL_000001__", "| a | b |", "__LT_REF_000002__ ``` | a | b |")], "p string, s string, t string")
    none = F.array().cast("array<struct<source_term:string,target_term:string,case_sensitive:boolean>>")
    issues = row.select(V.chunk_issues(F.col("p"), F.col("s"), F.col("t"), F.col("t"), none)).first()[0]
    assert issues == ["MISSING_PLACEHOLDER", "EXTRA_PLACEHOLDER", "BROKEN_CODE_FENCE", "TABLE_SHAPE_CHANGED"]
    assert row.select(V.chunk_issues(F.lit(""), F.lit("x"), F.lit(" \n"), F.lit(""), none)).first()[0] == ["EMPTY_OUTPUT"]


def test_pages_are_rewritten(spark):
    from quire.operators.blocks import page

    html = "<body><main><h1> A </h1><p>One &amp; two<b>x</b></p><pre>keep</pre></main></body>"
    texts = {b.start: b.text.upper() for b in page(html)}
    assert K.rewritten_page(html, texts) == "<body><main><h1> A </h1><p>ONE &amp; TWO<b>X</b></p><pre>keep</pre></main></body>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>same</p>")], "doc_id long, html string")
    nodes = spark.createDataFrame([(1, k, v) for k, v in texts.items()], "doc_id long, node int, text string")
    assert K.rewritten_page("<p>x</p><span>a</span>", {1: "Z"}) == "<p>x</p><span>Z</span>"
    assert K.rewritten_page("<p>Tom &amp;&nbsp;Ann</p> &quot;q&quot; <b>a</b>b", {0: "T & A", 1: "Q", 3: "c"}) == "<p>T &amp; A</p> Q <b>a</b>c"
    assert K.rewritten_page("<i>a</i><i>a</i><!-- a --><i>\na\n</i>", {1: "1", 2: "2"}) == "<i>a</i><i>1</i><!-- a --><i>\n2\n</i>"
    assert K.rewritten_page("<!DOCTYPE html>\n<p>a<br>a &lt; b", {1: "c", 2: "d<"}) == "<!DOCTYPE html>\n<p>c<br>d&lt;"
    got = {r.doc_id: r.html for r in K.rewritten_pages(pages, nodes).collect()}
    assert got[2] is None and got[3] == "<p>same</p>" and "ONE &amp; TWO" in got[1]


def test_splice(spark):
    docs = spark.createDataFrame([(1, "hello big world"), (2, "same")], "doc_id long, text string")
    changes = spark.createDataFrame([(1, 10, 15, "earth"), (1, 0, 5, "bye")], "doc_id long, start int, end int, text string")
    assert {r.doc_id: r.text for r in K.spliced_documents(docs, changes).collect()} == {1: "bye big earth", 2: "same"}
