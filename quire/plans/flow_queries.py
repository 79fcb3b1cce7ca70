"""Queries and SQL of the text dataflow: sources, blocks, chunks, masks, glossary, validation, sinks.

Greedy folds have recursive SQL; parsers of whole documents and Java-only patterns have none and are
tested against hand-made cases.
"""

from __future__ import annotations

from collections.abc import Callable
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import mask as M
from quire.operators import blocks as B
from quire.operators import chunks as C
from quire.operators import glossary as G
from quire.operators import sinks as K
from quire.operators import validate as V
from quire.plans import workflow
from quire.plans.common import BODY_SQL, LINES_SQL, bodies, line_rows, quoted, table
from quire.sources import files as S

SOFT, MOST = 200, 300
#: (source, target, case sensitive, priority)
TERMS = (("the", "THE", True, 90), ("Thing", "Ding", False, 100), ("ing", "ung", True, 100), ("token", "Zeichen", False, 50), ("nowhere", "nirgends", True, 10))
_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(s)}, {quoted(t)}, {str(c).lower()}, {p})" for s, t, c, p in TERMS) + ") t(source_term, target_term, case_sensitive, priority))"
_TRIM = "trim({}, chr(32) || chr(9) || chr(13) || chr(10))"


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERMS), "source_term string, target_term string, case_sensitive boolean, priority int")


def terms_array():
    return F.array(*(F.struct(F.lit(s).alias("source_term"), F.lit(t).alias("target_term"), F.lit(c).alias("case_sensitive"), F.lit(p).alias("priority")) for s, t, c, p in TERMS))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Lines that aren't blank as blocks; every seventh is a heading of level 1 to 3."""
    rows = line_rows(s, d).filter("trim(line) <> ''")
    return rows.select("doc_id", "pos", (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.col("line").alias("text"), F.when(F.col("pos") % 7 == 3, F.col("pos") % 3 + 1).cast("int").alias("heading"))


_FOLD = LINES_SQL + ", blk AS (SELECT doc_id, pos, doc_id * 100000 + pos AS id, line AS text, CASE WHEN pos % 7 = 3 THEN pos % 3 + 1 END AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lines WHERE trim(line) <> '')"


def _fold_sql(soft: int, most: int, overhead: int, by_heading: bool) -> str:
    cost = f"(greatest(1, length(b.text) // 4) + {overhead})"
    new = f"(f.n > 0 AND (({'coalesce(b.heading <= 2, false)' if by_heading else 'false'}) OR f.tokens + {cost} > {soft}))"
    sum_ = f"(CASE WHEN {new} THEN 0 ELSE f.tokens END + {cost})"
    return f"""WITH RECURSIVE {_FOLD}, fold AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS tokens, 0::BIGINT AS next_chunk, NULL::BIGINT AS chunk FROM (SELECT DISTINCT doc_id FROM blk)
 UNION ALL SELECT b.doc_id, b.k, CASE WHEN {sum_} >= {most} THEN 0 ELSE 1 END, CASE WHEN {sum_} >= {most} THEN 0 ELSE {sum_} END, f.next_chunk + {new}::INT + ({sum_} >= {most})::INT, f.next_chunk + {new}::INT FROM fold f JOIN blk b ON b.doc_id = f.doc_id AND b.k = f.k + 1),
 plan AS (SELECT b.doc_id, b.pos, b.id, b.text, f.chunk, last_value(CASE WHEN b.heading <= 2 THEN b.id END IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.pos ROWS UNBOUNDED PRECEDING) AS chapter FROM fold f JOIN blk b ON b.doc_id = f.doc_id AND b.k = f.k WHERE f.k > 0) """


def c1_chunks(s, d):
    return workflow.chunked(_lines(s, d), SOFT, MOST).select("doc_id", "chunk", "chapter", F.size("block_ids").alias("n_blocks"), "source_text")


def c2_chunk_plan(s, d):
    return C.planned(_lines(s, d).filter(F.length("text") > 20), SOFT, MOST).select("doc_id", "pos", "chunk")


def _cells(s, d):
    return bodies(s, d).select("doc_id", F.lit(0).alias("pos"), F.regexp_replace("body", "\n", "\n\n").alias("text"))


def c3_cell_parts(s, d):
    return C.split_cells(_cells(s, d), SOFT, MOST).select("doc_id", "pos", "part", F.length("text").alias("n"))


def c4_cell_text(s, d):
    return C.split_cells(bodies(s, d).select("doc_id", F.lit(0).alias("pos"), F.col("body").alias("text")), SOFT, MOST)


def c5_marked_chunks(s, d):
    plan = C.planned(_lines(s, d), SOFT, MOST, overhead=2)
    return C.chunks_of(plan, marker="__LT_HTML_BLOCK_%06d__").select("doc_id", "chunk", "chapter", "source_text")


def c6_block_chunks(s, d):
    return _lines(s, d).select("doc_id", F.col("pos").alias("chunk"), F.array("id").alias("block_ids"), F.col("text").alias("source_text")).select("doc_id", "chunk", F.element_at("block_ids", 1).alias("block_id"), "source_text")


def c7_masked_plan(s, d):
    plan = workflow.chunked(_lines(s, d), SOFT, MOST).select("doc_id", "chunk", M.masked(F.col("source_text")).alias("m"))
    return plan.select("doc_id", "chunk", F.col("m.protected").alias("source_text"), F.size("m.spans").alias("n_spans"))


def c8_small(s, d):
    return bodies(s, d).select("doc_id", C.is_small(F.col("body")).alias("small"))


def _turns(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "text")


def c9_batches(s, d):
    return C.batched(_turns(s, d), "conv_id", "turn", "text")


def c10_batch_statistics(s, d):
    return C.batch_statistics(c9_batches(s, d), "conv_id")


def c11_batch_parts(s, d):
    rows = _turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = F.when(F.col("conv_id") % 2 == 0, F.array_join("t.text", "\n\n")).otherwise(F.array_join("t.text", " "))
    sizes = F.transform("t", lambda x: F.length(x["text"]))
    return rows.select("conv_id", F.posexplode(C.batch_parts(whole, sizes)).alias("k", "part"))


def c12_skips_batching(s, d):
    rows = bodies(s, d).groupBy("source").agg(F.collect_set("lang").alias("formats"), F.count("*").alias("n"))
    return rows.select("source", C.skips_batching(F.transform("formats", lambda x: F.when(x == "es", "srt").otherwise(x)), F.col("n")).alias("skips"))


def _masked(s, d):
    return bodies(s, d).select("doc_id", "body", M.masked(F.col("body")).alias("m"))


def m1_matches(s, d):
    return bodies(s, d).select("doc_id", F.explode(M.matches(F.col("body"))).alias("x")).select("doc_id", "x.*")


def m2_accepted(s, d):
    return bodies(s, d).select("doc_id", F.explode(M.accepted(M.matches(F.col("body")))).alias("x")).select("doc_id", "x.*")


def m3_masked(s, d):
    return _masked(s, d).select("doc_id", "m.protected", F.to_json("m.spans").alias("spans"))


def m4_restored(s, d):
    """Texts masked and restored, and whether an address stayed outside the placeholders."""
    return _masked(s, d).select("doc_id", M.restored(F.col("m.protected"), F.col("m.spans")).alias("body"), F.col("m.protected").rlike(r"https?://\S").alias("bare_address"))


def m5_placeholders(s, d):
    x = F.concat("body", F.lit(" __LT_URL_000001__ __LT_REF_000002__ __LT_URL_000001__ __LT_bad_000001__"))
    return bodies(s, d).select("doc_id", F.array_join(M.placeholders(x), ",").alias("found"))


_NUMBERED = "CASE WHEN pos % 5 = 0 THEN (pos + 1) || '. ' || line WHEN pos % 11 = 1 THEN ' References ' ELSE line END"
_MARK = "__LT_HTML_BLOCK_\\d{6}__"


def _marked(s, d):
    text = F.format_string("__LT_HTML_BLOCK_%06d__\n %s \n__LT_HTML_BLOCK_000099__\n%s\n__LT_HTML_BLOCK_000099__ again", F.col("doc_id") % 50, F.col("body"), F.upper("body"))
    return bodies(s, d).select("doc_id", text.alias("text"))


def m6_marked_parts(s, d):
    parts = _marked(s, d).select("doc_id", M.marked_parts(F.col("text"), _MARK).alias("p"))
    return parts.select("doc_id", F.explode("p").alias("marker", "part"))


def m7_chosen_text(s, d):
    parts = M.marked_parts(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("plain")), _MARK)
    chosen = M.chosen_text(parts, F.lit("__LT_HTML_BLOCK_000099__"), F.lit("plain"), (F.col("doc_id") % 3).cast("int"), F.lit("source"), F.col("doc_id") % 5 == 0)
    return _marked(s, d).select("doc_id", chosen.alias("chosen"))


def g1_term_matches(s, d):
    return G.term_matches(bodies(s, d), terms(s), "body").select("doc_id", "source_term")


def _prompts(s, d):
    fmt = F.element_at(F.array(*map(F.lit, ("markdown", "html", "epub", "pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    p = G.prompt(fmt, F.col("body"), G.sorted_terms(terms_array()), F.lit("German"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")))
    return bodies(s, d).select("doc_id", p.alias("p"))


def g2_prompts(s, d):
    return _prompts(s, d).select("doc_id", "p.system", "p.user")


def g3_replaced(s, d):
    return _prompts(s, d).select("doc_id", G.replaced(G.prompt_text(F.col("p.user")), G.sorted_terms(terms_array())).alias("target"))


def _provider(system: str, user: str) -> str:
    if "(cid:" in user:
        raise ValueError("unreadable")
    return user.upper()


def g4_provided(s, d):
    out = G.provided(_prompts(s, d).select("doc_id", "p.system", "p.user"), _provider)
    return out.select("doc_id", F.md5("target_text").alias("target"), "error_message")


def g5_attempts(s, d):
    rows = bodies(s, d).select("doc_id", (F.col("doc_id") % 6).cast("int").alias("n"))
    return rows.select("doc_id", G.attempts_left(F.col("n")).alias("left"), G.status_after(F.col("doc_id") % 2 == 0, F.col("n")).alias("status"))


def g6_batch_status(s, d):
    return bodies(s, d).select("doc_id", G.status_after(F.col("doc_id") % 2 == 0, F.lit(0), True, F.col("doc_id") % 5 == 0).alias("status"))


def g7_chapter_label(s, d):
    fmt = F.element_at(F.array(*map(F.lit, ("markdown", "epub", "ipynb", "docx", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return bodies(s, d).select("doc_id", G.chapter_label(fmt, F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("label"))


def _pairs(s, d):
    """Texts before and after, with faults by id."""
    n, b = F.col("doc_id") % 6, F.col("body")
    after = F.when(n == 0, F.lit(" \n")).when(n == 1, F.replace(b, F.lit("__LT_URL_000001__"), F.lit(""))).when(n == 2, F.concat(b, F.lit(" ``` __LT_REF_000009__"))).when(n == 3, F.replace(b, F.lit("| 1 | 2 |"), F.lit("| 1 |"))).when(n == 4, F.concat(b, F.lit(" ("))).otherwise(b)
    return bodies(s, d).withColumn("body", F.concat("body", F.lit(" __LT_URL_000001__"))).withColumn("after", after)


_PAIR = BODY_SQL + ", b2 AS (SELECT doc_id, body || ' __LT_URL_000001__' AS body FROM body), pair AS (SELECT doc_id, body, CASE doc_id % 6 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN replace(body, '__LT_URL_000001__', '') WHEN 2 THEN body || ' ``` __LT_REF_000009__' WHEN 3 THEN replace(body, '| 1 | 2 |', '| 1 |') WHEN 4 THEN body || ' (' ELSE body END AS after FROM b2)"
_PH = "list_distinct(regexp_extract_all({}, '__LT_[A-Z_]+_\\d{{6}}__'))"
_SHAPE = "list_transform(list_filter(list_transform(string_split({}, chr(10)), lambda s: trim(s)), lambda s: contains(s, '|') AND NOT regexp_matches(s, '^\\|?\\s*:?-{{3,}}:?')), lambda s: len(string_split(trim(s, '|'), '|')))"


def v1_placeholders(s, d):
    a, b = F.col("body"), F.col("after")
    return _pairs(s, d).select("doc_id", F.array_join(V.lost(a, b), ",").alias("missing"), F.array_join(V.lost(b, a), ",").alias("extra"))


def v2_empty_output(s, d):
    return _pairs(s, d).select("doc_id", V.empty_output(F.col("after")).alias("empty"))


def v3_broken_fence(s, d):
    return _pairs(s, d).select("doc_id", V.broken_fence(F.col("after")).alias("broken"))


def v4_table_changed(s, d):
    return _pairs(s, d).select("doc_id", V.table_changed(F.col("body"), F.col("after")).alias("changed"))


def v5_missing_terms(s, d):
    found = V.missing_terms(F.col("body"), F.col("after"), terms_array())
    return _pairs(s, d).select("doc_id", F.explode(found).alias("t")).select("doc_id", "t.source_term")


def v6_docx_issues(s, d):
    return _pairs(s, d).select("doc_id", F.array_join(V.docx_chunk_issues(F.col("body"), F.col("after")), ",").alias("issues"))


def v7_untranslated(s, d):
    lines = _lines(s, d)
    done = workflow.chunked(lines, SOFT, MOST).withColumn("status", F.when(F.col("chunk") % 3 == 0, "FAILED").otherwise("DONE"))
    return V.untranslated(lines, done).select("doc_id", "id")


def _page_pairs(s, d):
    p = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))
    n = F.col("doc_id") % 4
    return p.withColumn("target", F.when(n == 0, F.replace("source", F.lit("href="), F.lit("data-x="))).when(n == 1, F.replace("source", F.lit("<p>"), F.lit("<p>x<b>y</b>"))).otherwise(F.col("source")))


def v8_page_issues(s, d):
    return V.html_issues(_page_pairs(s, d)).select("doc_id", F.array_join("issues", ",").alias("issues"))


def v10_latex_issues(s, d):
    x = F.concat("body", F.lit("\\begin{document} \\end{document}"))
    y = F.when(F.col("doc_id") % 2 == 0, x).otherwise(F.replace(x, F.lit("\\end{document}"), F.lit("")))
    return bodies(s, d).select("doc_id", F.array_join(V.latex_issues(x, y), ",").alias("issues"))


_CUES = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nOne\n\nNOTE skip\n\n00:03.500 --> 00:04.000 align:left\nTwo\nlines\n"


def _vtt(s, d):
    return bodies(s, d).select("doc_id", F.concat(F.lit(_CUES), F.lit("\n00:00:05.000 --> 00:00:06.000\n"), F.col("body")).alias("text"))


def v11_subtitle_issues(s, d):
    t = F.col("text")
    y = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.replace(t, F.lit("00:03.500"), F.lit("00:03.600"))).otherwise(F.replace(t, F.lit("WEBVTT\n"), F.lit("")))
    return _vtt(s, d).select("doc_id", F.array_join(V.subtitle_issues(t, y), ",").alias("issues"))


def _notebooks(s, d):
    cell = lambda kind, text: F.struct(F.lit(kind).alias("cell_type"), text.alias("source"))
    cells = F.array(cell("markdown", F.concat(F.lit("# Title\n"), F.col("body"))), cell("code", F.lit("print(1)")), cell("markdown", F.lit("## Part\ntext")), cell("markdown", F.lit(" ")))
    return bodies(s, d).select("doc_id", F.to_json(F.struct(cells.alias("cells"))).alias("text"))


def v12_notebook_issues(s, d):
    a = B.parsed(_notebooks(s, d), B.notebook)
    b = a.filter("not (doc_id % 3 = 1 and pos = 3)").withColumn("text", F.when((F.col("doc_id") % 3 == 2) & (F.col("pos") == 1), "changed").otherwise(F.col("text")))
    return V.notebook_issues(a, b).select("doc_id", F.array_join("issues", ",").alias("issues"))


def v13_forced_draft(s, d):
    rows = table(s, d, "labels").select((F.col("doc_id") % 40).alias("doc_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("status"))
    return V.forced_draft(rows)


def b1_paragraphs(s, d):
    return B.paragraphs(line_rows(s, d)).withColumn("block", F.col("block").cast("long"))


def b2_markdown_blocks(s, d):
    return B.parsed(bodies(s, d), B.markdown, "body")


def b3_heading_parents(s, d):
    return B.parsed(bodies(s, d), B.markdown, "body").select("doc_id", "pos", "parent")


def b4_structure_blocks(s, d):
    return B.parsed(bodies(s, d), B.structure, "body")


def _pages(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("doc_id"), "html")


def b5_page_nodes(s, d):
    return B.parsed(_pages(s, d), B.page, "html")


def b6_main_text(s, d):
    return B.parsed(_pages(s, d), B.main_text, "html")


def b7_book_nodes(s, d):
    return B.parsed(_pages(s, d), B.book_part, "html")


def b8_archive_names(s, d):
    """References of pages resolved against the pages' own paths: equal, or the only one that ends with it."""
    names = table(s, d, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("name")).distinct()
    refs = names.select(F.regexp_extract("name", r"([^/]+)$", 1).alias("href")).distinct()
    by_end = names.select("name", F.regexp_extract("name", r"([^/]+)$", 1).alias("href")).filter("name <> href").groupBy("href").agg(F.count("*").alias("k"), F.min("name").alias("only"))
    exact = refs.join(names.withColumnRenamed("name", "href").withColumn("same", F.lit(True)), "href", "left")
    return exact.join(by_end, "href", "left").select("href", F.when(F.col("same"), F.col("href")).when(F.col("k") == 1, F.col("only")).otherwise(F.col("href")).alias("name"))


def b9_notebook_blocks(s, d):
    return B.parsed(_notebooks(s, d), B.notebook)


def _tex(s, d):
    return bodies(s, d).select("doc_id", F.concat(F.lit("\\title{On \\emph{it}} % note\n\\section[short]{A {nested} one}\n$x=1$\n\n"), F.col("body"), F.lit("\n\\begin{verbatim}\nraw\n\\end{verbatim}\n\nLast words.")).alias("text"))


def b10_latex_blocks(s, d):
    return B.parsed(_tex(s, d), B.latex)


def b11_subtitle_cues(s, d):
    return B.parsed(_vtt(s, d), B.vtt)


def b12_docx_blocks(s, d):
    rows = line_rows(s, d)
    style = F.element_at(F.array(*map(F.lit, ("Normal", "Heading 2", "Code", "Title"))), (F.col("pos") % 4 + 1).cast("int"))
    paragraphs = rows.select("doc_id", F.col("pos").alias("index"), F.col("line").alias("text"), style.alias("style"))
    tables = bodies(s, d).select("doc_id", F.lit(0).alias("index"), F.split("body", "[ \n]").alias("cells"))
    return B.docx_blocks(paragraphs, tables).withColumn("block", F.col("block").cast("long"))


def b13_pdf_kinds(s, d):
    x = F.when(F.col("pos") % 5 == 0, F.concat_ws(". ", (F.col("pos") + 1).cast("string"), "line")).when(F.col("pos") % 11 == 1, " References ").otherwise(F.col("line"))
    return line_rows(s, d).select("doc_id", F.col("pos").cast("long").alias("pos"), B.pdf_kind(x).alias("k")).select("doc_id", "pos", "k.kind", "k.level")


def _spans(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 400).alias("start"), (F.col("o_orderkey") % 400 + F.col("o_orderkey") % 60).alias("end"))


def i1_merged(s, d):
    return B.merged_spans(_spans(s, d))


def i2_gaps(s, d):
    merged = B.merged_spans(_spans(s, d))
    return B.gaps(merged, table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(500).alias("length")))


def i3_inside(s, d):
    merged = B.merged_spans(_spans(s, d)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    points = _spans(s, d).select("doc_id", ((F.col("start") * 7) % 500).alias("at")).distinct()
    return points.join(merged, "doc_id").select("doc_id", "at", F.exists("spans", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["end"])).alias("inside"))


def i4_trimmed(s, d):
    x = F.concat(F.lit(" \t"), "line", F.lit("  "))
    lead = F.length(F.regexp_extract(x, r"^\s*", 0))
    bare = F.length(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return line_rows(s, d).select("doc_id", F.col("pos").cast("long").alias("pos"), lead.alias("start"), (lead + bare).alias("end"))


def i5_balanced(s, d):
    return B.parsed(_tex(s, d), lambda t: [B.Block("argument", t[a : b + 1], start=a) for a, b in sorted(B.pairs(t, "{", "}").items())])


def k1_translated(s, d):
    return K.translated(_done(s, d), True)


def k5_plain_text(s, d):
    return K.translated(_done(s, d), False)


def _done(s, d):
    t = _turns(s, d)
    return t.select(F.col("conv_id").alias("project_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("chunk_order"), F.col("text").alias("source_text"), F.when(F.col("turn") % 4 != 1, F.lower("text")).alias("restored_text"), F.when(F.col("turn") % 4 != 1, "DONE").otherwise("FAILED").alias("status"))


def k2_bilingual(s, d):
    return K.bilingual(_done(s, d))


def k3_log(s, d):
    return K.log(_done(s, d)).select("project_id", "chunk_order", F.get_json_object("entry", "$.status").alias("status"), F.get_json_object("entry", "$.id").cast("long").alias("id"))


def k4_report_table(s, d):
    rows = table(s, d, "labels").select((F.col("doc_id") % 9).alias("project_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("status"), F.when(F.col("quality") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("EMPTY_OUTPUT"), F.lit("TERM_MISSING"))).alias("issues"))
    return K.report_table(rows).select("project_id", "id", "row")


def k6_cells(s, d):
    cells = B.parsed(_notebooks(s, d), B.notebook).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    parts = C.split_cells(cells, SOFT, MOST)
    n = parts.groupBy("doc_id", "pos").agg(F.count("*").alias("n_parts"))
    parts = parts.join(n, ["doc_id", "pos"]).withColumn("restored_text", F.when((F.col("doc_id") % 4 != 0) | (F.col("part") > 0), F.upper("text")))
    return K.cells(cells, parts, True)


def k7_pages(s, d):
    nodes = B.parsed(_pages(s, d), B.page, "html").select("doc_id", F.col("start").alias("node"), F.upper("text").alias("text"))
    return K.rewritten_pages(_pages(s, d), nodes)


def k8_spliced(s, d):
    found = B.parsed(_tex(s, d), B.latex)
    return K.spliced_documents(_tex(s, d), found.select("doc_id", "start", "end", F.upper("text").alias("text")))


def k10_block_texts(s, d):
    rows = workflow.chunked(_lines(s, d), SOFT, MOST).withColumn("restored_text", F.lower("source_text"))
    return K.block_texts(rows)


def s1_formats(s, d):
    rows = bodies(s, d).select("doc_id", F.concat(F.lit("dir.v1/File."), F.element_at(F.array(*map(F.lit, ("md", "TXT", "htm", "tex", "srt", "vtt", "ipynb", "epub", "docx", "pdf"))), (F.col("doc_id") % 10 + 1).cast("int"))).alias("path"))
    return rows.select("doc_id", S.format_of(F.col("path")).alias("format"))


def s4_decoded_pages(s, d):
    """Pages as bytes of ASCII characters, decoded by the first encoding that takes them (other encodings: tests)."""
    rows = table(s, d, "pages").select("page_id", F.encode(F.regexp_replace("html", r"[^\x00-\x7F]", "?"), "UTF-8").alias("content"))
    return S.parsed_bytes(rows, S.page_text, "text string", "page_id")


def _archives(s, d, parts: Callable[[str], list[tuple[str, bytes]]], rows: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([S.zipped(parts(x.as_py() or "")) for x in batch.column(1)], pa.binary())], names=[key, "content"])

    return rows.select(key, text).mapInArrow(run, f"{key} long, content binary")


_CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
_PACKAGE = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>'


def _book(html: str) -> list[tuple[str, bytes]]:
    parts = {"META-INF/container.xml": _CONTAINER, "O/p.opf": _PACKAGE, "O/c.xhtml": html, "O/nav.xhtml": "<nav/>", "mimetype": "application/epub+zip"}
    return [(k, v.encode()) for k, v in parts.items()]


def s9_books(s, d):
    """Pages put in books' archives and read back."""
    return S.parsed_bytes(_archives(s, d, _book, table(s, d, "pages"), "page_id", "html"), S.epub_files, S.EPUB_SCHEMA, "page_id")


def _books_out(s, d):
    """Books' files with every text node of a chapter in capitals, put in archives and read back."""
    pages = _pages(s, d)
    nodes = B.parsed(pages, B.book_part, "html").select("doc_id", F.col("start").alias("node"), F.upper("text").alias("text"))
    out = K.rewritten_pages(pages, nodes).select(F.col("doc_id").alias("page_id"), "html")
    return S.parsed_bytes(_archives(s, d, _book, out, "page_id", "html"), S.epub_files, S.EPUB_SCHEMA, "page_id")


def k9_books(s, d):
    return _books_out(s, d)


def v9_book_issues(s, d):
    both = s9_books(s, d).select("page_id", "name", F.col("markup").alias("source")).join(_books_out(s, d).select("page_id", "name", F.col("markup").alias("target")), ["page_id", "name"])
    return V.html_issues(both.select(F.concat_ws("/", "page_id", "name").alias("file"), "source", "target"), "file", B.BOOK_SKIP).select("file", F.array_join("issues", ",").alias("issues"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _office(text: str) -> list[tuple[str, bytes]]:
    rows = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    return [("word/document.xml", f"<w:document {_W}><w:body>{rows}</w:body></w:document>".encode())]


def s10_docx(s, d):
    """Documents put in office files, a paragraph for each line, and read back."""
    found = S.parsed_bytes(_archives(s, d, _office, table(s, d, "documents"), "doc_id", "text"), S.docx_parts, S.DOCX_SCHEMA, "doc_id")
    return found.select("doc_id", "part", F.col("index").alias("pos"), "text", "style")


def s13_table_scan(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def s15_listing(s, d):
    return S.listing(s, f"{d}/*.parquet").select("name", (F.col("length") > 0).alias("has_bytes"))


def k12_snapshot(s, d):
    path = S.scratch(s)
    S.snapshot(table(s, d, "conversations"), path)
    return s.read.parquet(path)


def s12_glossary(s, d):
    c = table(s, d, "customer")
    rows = c.select(F.col("c_name").alias("source_term"), F.when(F.col("c_custkey") % 10 > 0, F.upper("c_name")).alias("target_term"), F.when(F.col("c_custkey") % 3 == 0, "False").alias("case_sensitive"), F.lit(None).cast("string").alias("match_type"), F.when(F.col("c_custkey") % 4 == 0, "7").when(F.col("c_custkey") % 4 == 1, "x").alias("priority"), F.when(F.col("c_custkey") % 5 == 0, "TRUE").alias("locked"), F.lit(None).cast("string").alias("note"))
    return S.glossary_terms(rows).drop("note")


def flow_workflow(s, d):
    """The workflow end to end: issues of chunks by status."""
    return workflow.issue_counts(workflow.run(_lines(s, d), terms_array(), SOFT, MOST))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    names = [n for n in own if n[:1] in "bcgikmsv" and n[1:2].isdigit()] + ["flow_workflow"]
    return {n: own[n] for n in names}


_BLANK = "trim(line, chr(32) || chr(9) || chr(13))"
_TURNS = "t AS (SELECT conv_id, turn, text, length(text) AS n, (len(regexp_extract_all(text, '\\S+')) < 100 OR length(text) < 500) AS small, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"
_NEWB = "(f.open_ > 0 AND (NOT t.small OR f.chars + t.n > 3000))"
_BATCH = f"WITH RECURSIVE {_TURNS}, fold AS (SELECT conv_id, 0::BIGINT AS k, 0 AS open_, 0::BIGINT AS chars, 0::BIGINT AS next_, NULL::BIGINT AS batch, NULL::BIGINT AS turn, NULL::BIGINT AS n, NULL::BOOLEAN AS small FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT t.conv_id, t.k, CASE WHEN t.small THEN 1 ELSE 0 END, CASE WHEN t.small THEN CASE WHEN {_NEWB} THEN 0 ELSE f.chars END + t.n ELSE 0 END, f.next_ + {_NEWB}::INT + (NOT t.small)::INT, f.next_ + {_NEWB}::INT, t.turn, t.n, t.small FROM fold f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1), batch AS (SELECT conv_id, turn, n, small, batch FROM fold WHERE k > 0) "
_SPAN = "span AS (SELECT o_custkey AS doc_id, o_orderkey % 400 AS start, o_orderkey % 400 + o_orderkey % 60 AS end_ FROM orders)"
_MERGE = f"{_SPAN}, far AS (SELECT *, max(end_) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM span WHERE start < end_), isl AS (SELECT *, sum(CASE WHEN f IS NULL OR start > f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS i FROM far), merged AS (SELECT doc_id, min(start) AS start, max(end_) AS end_ FROM isl GROUP BY doc_id, i)"
_DONE = "done AS (SELECT conv_id AS project_id, conv_id * 1000 + turn AS id, turn AS chunk_order, text AS source_text, CASE WHEN turn % 4 <> 1 THEN lower(text) END AS restored_text, CASE WHEN turn % 4 <> 1 THEN 'DONE' ELSE 'FAILED' END AS status FROM conversations)"

_MARKED = "printf('__LT_HTML_BLOCK_%06d__', doc_id % 50) || chr(10) || ' ' || body || ' ' || chr(10) || '__LT_HTML_BLOCK_000099__' || chr(10) || upper(body) || chr(10) || '__LT_HTML_BLOCK_000099__ again'"
_PARTS = f"t AS (SELECT doc_id, {_MARKED} AS t FROM body), k AS (SELECT doc_id, regexp_extract_all(t, '{_MARK}') AS k, regexp_split_to_array(t, '{_MARK}')[2:] AS v FROM t), r AS (SELECT doc_id, unnest(range(len(k))) AS i, unnest(k) AS marker, unnest(v) AS part FROM k), parts AS (SELECT doc_id, marker, arg_max(part, i) AS part FROM r GROUP BY 1, 2)"


def oracle_sql() -> dict[str, str]:
    body = f"WITH {BODY_SQL} "
    pair = f"WITH {_PAIR} "
    a, b = _PH.format("body"), _PH.format("after")
    lost = "coalesce(array_to_string(list_sort(list_filter({0}, lambda p: NOT list_contains({1}, p))), ','), '')"
    shape_a, shape_b = _SHAPE.format("body"), _SHAPE.format("after")
    n_lines = "len(list_filter(regexp_split_to_array({}, '\\n\\s*\\n'), lambda p: " + _TRIM.format("p") + " <> ''))"
    c = lambda x, s: f"(length({x}) - length(replace({x}, '{s}', '')))"
    docx = [(" OR ".join(f"{c('after', l)} <> {c('after', r)}" for l, r in ("()", "[]", "{}")), "UNBALANCED_BRACKETS"), (f"abs({n_lines.format('body')} - {n_lines.format('after')}) > greatest(2.0, {n_lines.format('body')} * 0.5)", "PARAGRAPH_COUNT_CHANGED"), ("len(regexp_extract_all(body, '(?m)^#{1,6}\\s')) <> len(regexp_extract_all(after, '(?m)^#{1,6}\\s'))", "HEADING_COUNT_CHANGED"), ("length(body) > 0 AND (length(after) < length(body) * 0.1 OR length(after) > length(body) * 5)", "LENGTH_SUSPICIOUS")]
    issues = lambda xs: "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} THEN '{n}' END" for k, n in xs) + "], lambda x: x IS NOT NULL), ','), '')"
    every = lambda x, p: f"regexp_extract_all({x}, {quoted(p)})"
    latex = [(f"{_TRIM.format('y')} = ''", "EMPTY_ARTIFACT"), ("contains(x, '\\end{document}') AND NOT contains(y, '\\end{document}')", "END_DOCUMENT_MISSING"), (f"{every('x', V.ENVIRONMENT)} <> {every('y', V.ENVIRONMENT)}", "ENVIRONMENT_CHANGED")]
    subtitles = [(f"len({every('x', V.TIMING)}) <> len({every('y', V.TIMING)})", "CUE_COUNT_CHANGED"), (f"{every('x', V.TIMING)} <> {every('y', V.TIMING)}", "TIMING_CHANGED"), ("starts_with(x, 'WEBVTT') AND NOT starts_with(y, 'WEBVTT')", "HEADER_MISSING")]
    contains = "CASE WHEN case_sensitive THEN contains(body, source_term) ELSE contains(lower(body), lower(source_term)) END"
    return {
        "c1_chunks": _fold_sql(SOFT, MOST, 0, True) + "SELECT doc_id, chunk, chapter, count(*) AS n_blocks, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS source_text FROM plan GROUP BY 1, 2, 3",
        "c2_chunk_plan": _fold_sql(SOFT, MOST, 0, True).replace("WHERE trim(line) <> ''", "WHERE trim(line) <> '' AND length(line) > 20") + "SELECT doc_id, pos, chunk FROM plan",
        "c5_marked_chunks": _fold_sql(SOFT, MOST, 2, True) + "SELECT doc_id, chunk, chapter, string_agg('__LT_HTML_BLOCK_' || lpad((pos + 1)::VARCHAR, 6, '0') || '__' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS source_text FROM plan GROUP BY 1, 2, 3",
        "c6_block_chunks": f"WITH {_FOLD} SELECT doc_id, pos AS chunk, id AS block_id, text AS source_text FROM blk",
        "c8_small": body + "SELECT doc_id, len(regexp_extract_all(body, '\\S+')) < 100 OR length(body) < 500 AS small FROM body",
        "c9_batches": _BATCH + "SELECT * FROM batch",
        "c10_batch_statistics": _BATCH + "SELECT conv_id, sum(k) AS n_chunks, count(*) AS n_batches, avg(k) AS mean_size, max(k) AS most, min(k) AS least, count(*) FILTER (k = 1) AS singles, count(*) FILTER (k > 1) AS multis FROM (SELECT conv_id, batch, count(*) AS k FROM batch GROUP BY 1, 2) GROUP BY 1",
        "c12_skips_batching": body + "SELECT source, count(*) = 1 OR bool_or(lang = 'es') AS skips FROM body GROUP BY 1",
        # every address is to be hidden by a placeholder, so an engine that masks nothing differs
        "m4_restored": body + "SELECT doc_id, body, false AS bare_address FROM body",
        "m5_placeholders": body + ", h AS (SELECT doc_id, regexp_extract_all(body || ' __LT_URL_000001__ __LT_REF_000002__ __LT_URL_000001__ __LT_bad_000001__', '__LT_[A-Z_]+_\\d{6}__') AS h FROM body), e AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS h FROM h), f AS (SELECT doc_id, h, min(i) AS i FROM e GROUP BY 1, 2) SELECT doc_id, string_agg(h, ',' ORDER BY i) AS found FROM f GROUP BY 1",
        "m6_marked_parts": body + f", {_PARTS} SELECT doc_id, marker, {_TRIM.format('part')} AS part FROM parts",
        "m7_chosen_text": body + f", {_PARTS} SELECT b.doc_id, coalesce({_TRIM.format('part')}, CASE WHEN b.doc_id % 3 = 1 AND b.doc_id % 2 = 1 THEN 'plain' END, CASE WHEN b.doc_id % 5 = 0 THEN 'source' END) AS chosen FROM body b LEFT JOIN parts p ON p.doc_id = b.doc_id AND b.doc_id % 2 = 0 AND marker = '__LT_HTML_BLOCK_000099__'",
        "g1_term_matches": body + f", {_TERMS_SQL} SELECT doc_id, source_term FROM body JOIN terms ON {contains}",
        "g5_attempts": body + "SELECT doc_id, greatest(0, 3 - doc_id % 6 + 1) AS left, CASE WHEN doc_id % 2 = 0 THEN 'DONE' WHEN doc_id % 6 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status FROM body",
        "g6_batch_status": body + "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' WHEN doc_id % 2 = 0 THEN 'DONE' ELSE 'NEED_REVIEW' END AS status FROM body",
        "g7_chapter_label": body + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['Chapter', 'File', 'Cell under', 'Section', 'Page'][doc_id % 5 + 1] || ': ' || source END AS label FROM body",
        "v1_placeholders": pair + f"SELECT doc_id, {lost.format(a, b)} AS missing, {lost.format(b, a)} AS extra FROM pair",
        "v2_empty_output": pair + f"SELECT doc_id, {_TRIM.format('after')} = '' AS empty FROM pair",
        "v3_broken_fence": pair + "SELECT doc_id, ((length(after) - length(replace(after, '```', ''))) // 3) % 2 = 1 AS broken FROM pair",
        "v4_table_changed": pair + f"SELECT doc_id, len({shape_a}) > 0 AND len({shape_b}) > 0 AND {shape_a} <> {shape_b} AS changed FROM pair",
        "v5_missing_terms": pair + f", {_TERMS_SQL} SELECT doc_id, source_term FROM pair JOIN terms ON {contains} AND NOT contains(after, target_term)",
        "v6_docx_issues": pair + f"SELECT doc_id, {issues(docx)} AS issues FROM pair",
        "v7_untranslated": _fold_sql(SOFT, MOST, 0, True) + "SELECT doc_id, id FROM plan WHERE chunk % 3 = 0",
        "v10_latex_issues": body + f", x AS (SELECT doc_id, body || '\\begin{{document}} \\end{{document}}' AS x FROM body), xy AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN x ELSE replace(x, '\\end{{document}}', '') END AS y FROM x) SELECT doc_id, {issues(latex)} AS issues FROM xy",
        "v11_subtitle_issues": body + f", x AS (SELECT doc_id, {quoted(_CUES)} || chr(10) || '00:00:05.000 --> 00:00:06.000' || chr(10) || body AS x FROM body), xy AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN x WHEN 1 THEN replace(x, '00:03.500', '00:03.600') ELSE replace(x, 'WEBVTT' || chr(10), '') END AS y FROM x) SELECT doc_id, {issues(subtitles)} AS issues FROM xy",
        "v12_notebook_issues": body + "SELECT doc_id, ['', 'CELL_COUNT_CHANGED', 'CELL_CONTENT_CHANGED'][doc_id % 3 + 1] AS issues FROM body",
        "v13_forced_draft": "SELECT doc_id % 40 AS doc_id, bool_or(quality <> 1) AS draft FROM labels GROUP BY 1",
        "b1_paragraphs": f"WITH {LINES_SQL}, g AS (SELECT *, sum(({_BLANK} = '')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gap FROM lines), r AS (SELECT doc_id, gap, min(pos) AS first, string_agg(rtrim(line, chr(32) || chr(9) || chr(13)), chr(10) ORDER BY pos) AS t FROM g WHERE {_BLANK} <> '' GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS block, {_TRIM.format('t')} AS text FROM r",
        "b8_archive_names": "WITH n AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS name FROM pages), e AS (SELECT name, regexp_extract(name, '([^/]+)$', 1) AS href FROM n), r AS (SELECT DISTINCT href FROM e) SELECT href, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.name = r.href) THEN href WHEN (SELECT count(*) FROM e WHERE e.href = r.href AND ends_with(e.name, '/' || r.href)) = 1 THEN (SELECT min(e.name) FROM e WHERE e.href = r.href AND e.name <> r.href) ELSE href END AS name FROM r",
        "b13_pdf_kinds": f"WITH {LINES_SQL}, x AS (SELECT doc_id, pos, {_TRIM.format(_NUMBERED)} AS t FROM lines), h AS (SELECT doc_id, pos, regexp_replace(t, '\\s+', ' ', 'g') AS t FROM x), k AS (SELECT doc_id, pos, (regexp_matches(t, '^\\d+\\.\\s+\\S+') AND length(t) < 120) OR lower(t) = 'references' AS hd FROM h) SELECT doc_id, pos, CASE WHEN hd THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN hd THEN 1 END AS level FROM k",
        "i1_merged": f"WITH {_MERGE} SELECT doc_id, start, end_ AS \"end\" FROM merged",
        "i2_gaps": f"WITH {_MERGE}, g AS (SELECT doc_id, coalesce(lag(end_) OVER (PARTITION BY doc_id ORDER BY start), 0) AS start, start AS e FROM merged UNION ALL SELECT c_custkey, coalesce((SELECT max(end_) FROM merged m WHERE m.doc_id = c_custkey), 0), 500 FROM customer) SELECT doc_id, start, e AS \"end\" FROM g WHERE start < e",
        "i3_inside": f"WITH {_MERGE}, p AS (SELECT DISTINCT doc_id, (start * 7) % 500 AS at_ FROM span WHERE doc_id IN (SELECT doc_id FROM merged)) SELECT doc_id, at_ AS \"at\", EXISTS (SELECT 1 FROM merged m WHERE m.doc_id = p.doc_id AND m.start <= at_ AND at_ < m.end_) AS inside FROM p",
        "i4_trimmed": f"WITH {LINES_SQL}, x AS (SELECT doc_id, pos, chr(32) || chr(9) || line || chr(32) || chr(32) AS x FROM lines) SELECT doc_id, pos, length(x) - length(ltrim(x, chr(32) || chr(9))) AS start, length(x) - length(ltrim(x, chr(32) || chr(9))) + length(trim(x, chr(32) || chr(9))) AS \"end\" FROM x",
        "k1_translated": f"WITH {_DONE} SELECT project_id, string_agg(coalesce(restored_text, '<!-- TODO: ' || id || ' -->'), chr(10) || chr(10) ORDER BY chunk_order) AS content FROM done GROUP BY 1",
        "k5_plain_text": f"WITH {_DONE} SELECT project_id, coalesce(string_agg(restored_text, chr(10) || chr(10) ORDER BY chunk_order), '') AS content FROM done GROUP BY 1",
        "k2_bilingual": f"WITH {_DONE} SELECT project_id, string_agg('## Source: ' || id || chr(10) || chr(10) || source_text || chr(10) || chr(10) || '## Translation: ' || id || chr(10) || chr(10) || coalesce(restored_text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_order) AS content FROM done GROUP BY 1",
        "k3_log": f"WITH {_DONE} SELECT project_id, chunk_order, status, id FROM done",
        "k4_report_table": "SELECT doc_id % 9 AS project_id, doc_id AS id, '| ' || doc_id || ' | ' || CASE WHEN quality = 1 THEN 'PASS | -' ELSE 'FAIL | EMPTY_OUTPUT; TERM_MISSING' END || ' |' AS row FROM labels",
        "k10_block_texts": f"WITH {_FOLD} SELECT id AS block_id, lower(text) AS text FROM blk",
        "s1_formats": body + ", path AS (SELECT doc_id, lower(regexp_extract('dir.v1/File.' || ['md', 'TXT', 'htm', 'tex', 'srt', 'vtt', 'ipynb', 'epub', 'docx', 'pdf'][doc_id % 10 + 1], '\\.([^./]+)$', 1)) AS e FROM body) SELECT doc_id, CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SUFFIXES.items()) + " END AS format FROM path",
        "s4_decoded_pages": "SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g') AS text FROM pages",
        "v9_book_issues": "SELECT page_id || '/O/c.xhtml' AS file, '' AS issues FROM pages UNION ALL SELECT page_id || '/O/nav.xhtml', '' FROM pages",
        "s9_books": "SELECT page_id, 0 AS place, 'O/c.xhtml' AS name, html AS markup, false AS is_nav FROM pages UNION ALL SELECT page_id, 1, 'O/nav.xhtml', '<nav/>', true FROM pages",
        "s10_docx": "WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, 'paragraph' AS part, unnest(range(len(l))) AS pos, unnest(l) AS text, 'Normal' AS style FROM r",
        "s13_table_scan": "SELECT c_custkey AS id, c_name AS name FROM customer",
        "k12_snapshot": "SELECT * FROM conversations",
        "s12_glossary": "SELECT c_name AS source_term, upper(c_name) AS target_term, c_custkey % 3 <> 0 AS case_sensitive, 'exact' AS match_type, CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE 100 END AS priority, c_custkey % 5 = 0 AS locked FROM customer WHERE c_custkey % 10 > 0",
    }
