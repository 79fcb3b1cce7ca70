import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import mask as M
from quire.functions import text as T

EDGES = ["", " ", "\n", "a", "no newline", "crlf\r\nline\r\n", "\ufeffbom", "x\x0by\x1cz\u2028w", "😀 astral 😀", "(cid:1)" * 11, "\ufffd\ue000\x01", "...word!!! 'q' \"z\"", "| a | b |\n|---|:-:|\n| 1 |", "é à ü", "page 12", "17"]


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def garbled(x):
    return sum(c == "\ufffd" or 0xE000 <= ord(c) <= 0xF8FF or (ord(c) < 32 and c not in "\n\r\t") for c in x) / len(x) if x else 1.0


def test_ratios(spark):
    words = lambda x: re.findall(r"\S+", x)
    assert column(spark, EDGES, T.garbled_ratio) == pytest.approx([garbled(x) for x in EDGES])
    assert column(spark, EDGES, T.printable_ratio) == pytest.approx([sum(c.isprintable() or c in "\n\r\t" for c in x) / len(x) if x else 0.0 for x in EDGES])
    assert column(spark, EDGES, T.word_count) == [len(words(x)) for x in EDGES]
    assert column(spark, EDGES, T.mean_word_length) == pytest.approx([sum(len(w.strip(T.EDGE)) for w in words(x)) / len(words(x)) if words(x) else 0.0 for x in EDGES])
    assert column(spark, EDGES, T.token_estimate) == [max(1, len(x) // 4) for x in EDGES]
    assert column(spark, ["(cid:1)" * n for n in (0, 3, 4, 10, 11)], lambda x: T.cid_severity(T.count(x, T.CID))) == ["none", "minor", "moderate", "moderate", "critical"]


def test_lines_and_strip(spark):
    assert column(spark, EDGES, T.lines) == [x.splitlines() for x in EDGES]
    assert column(spark, EDGES, T.strip) == [re.sub(r"^\s+|\s+$", "", x) for x in EDGES]


def test_table_shape_and_headings(spark):
    assert column(spark, ["| a | b |\n| --- | --- |\n| 1 | 2 |", "no table", "a|b|c"], T.table_shape) == [[2, 2], [], [3]]
    got = column(spark, ["Chapter 1.2 Title", "3. Next", "Plain"], T.heading_number)
    assert [tuple(r) for r in got] == [("Chapter 1.2", "Title"), ("3.", "Next"), (None, "Plain")]


def test_code_fences():
    text = "intro\ndef f(x):\n\nimport os\nend"
    assert T.code_fences(text) == "intro\n```python\ndef f(x):\n\nimport os\n```\nend"
    assert T.code_fences("plain\ntext") == "plain\ntext"


def spans_of(text):
    """Matches of all kinds, then those that don't overlap an accepted one."""
    found = []
    for no, (name, pattern, group) in enumerate(M.PATTERNS):
        for m in re.finditer(pattern, text, re.M):
            if name == "HTML_BLOCK" and "```" in m[0]:
                continue
            a, b = m.span(1) if group else m.span()
            found.append((a, a - b, no, b))
    out, last = [], -1
    for a, _, no, b in sorted(found):
        if a >= last:
            out.append((a, b, M.PATTERNS[no][0]))
            last = b
    return out


PARTS = ["plain ", "`code`", "```\nblock\n```", "<b>bold</b>", "<x a='1'>", "https://a.b/c) ", "[12]", "[t](p/q.md)", "![i](u.png)", "GET /v1/x ", "/usr/lib/x ", "C:\\dir\\f ", "./rel ", "\n", "é", "~~~a~~~", "<p>```</p>", "a/b", "$1 \\"]


def texts_of(n):
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


def test_masks_equal_python(spark):
    texts = [*texts_of(250), "", "https://a.b.", "[x](https://a.b/c)"]
    got = column(spark, texts, M.masked)
    for text, r in zip(texts, got):
        want = spans_of(text)
        assert [(s.start_offset, s.end_offset, s.span_type) for s in r.spans] == want, text
        out, at = [], 0
        for k, (a, b, kind) in enumerate(want, 1):
            out += [text[at:a], f"__LT_{kind}_{k:06d}__"]
            at = b
        assert r.protected == "".join(out) + text[at:]
        assert all(text[s.start_offset : s.end_offset] == s.original_text for s in r.spans)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab`<>/[]()!\n ~$\\é:hps.", max_size=60), min_size=20, max_size=40))
def test_restore_is_identity(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").withColumn("m", M.masked(F.col("x")))
    assert rows.filter(M.restored(F.col("m.protected"), F.col("m.spans")) != F.col("x")).count() == 0


def test_marked_parts(spark):
    mark = r"__LT_HTML_BLOCK_\d{6}__"
    got = column(spark, ["lead __LT_HTML_BLOCK_000001__ a __LT_HTML_BLOCK_000002__\nb\n__LT_HTML_BLOCK_000001__ c", "none", ""], lambda x: M.marked_parts(x, mark))
    assert got == [{"__LT_HTML_BLOCK_000002__": "b", "__LT_HTML_BLOCK_000001__": "c"}, {}, {}]
