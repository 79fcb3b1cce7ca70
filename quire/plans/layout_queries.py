"""Queries and SQL of the layout analytics (P1 to P19), on blocks laid over the lines of the documents.

Twelve lines make a page; places follow from the id and the line, by the same expression in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.plans.common import BODY_SQL, LINES_SQL, bodies, line_rows, quoted

#: valid in Spark and DuckDB
_PLACE = "doc_id, CAST(floor(pos / 12) AS BIGINT) AS page_index, pos % 12 AS block_no, CAST((doc_id * 7 + (pos % 3) * 190 + (pos % 2) * 4) % 560 AS DOUBLE) AS x0, CAST(760 - floor((pos % 12) / 3) * 190 - (doc_id % 5) AS DOUBLE) AS y0, CAST((doc_id * 7 + (pos % 3) * 190 + (pos % 2) * 4) % 560 + 120 + (pos % 4) * 10 AS DOUBLE) AS x1, CAST(760 - floor((pos % 12) / 3) * 190 - (doc_id % 5) + 30 AS DOUBLE) AS y1, CASE WHEN pos % 12 = 11 THEN 'Page ' || CAST(floor(pos / 12) + 1 AS INT) WHEN pos % 12 = 0 THEN 'Running head' ELSE line END AS text"
_IMAGE = "doc_id, page_index, CAST(20 * (doc_id % 9) AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(20 * (doc_id % 9) + 300 + 60 * (doc_id % 6) AS DOUBLE) AS x1, CAST(300 + 100 * (doc_id % 6) AS DOUBLE) AS y1"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows(spark, sf_dir).selectExpr(*_split(_PLACE))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "page_index").distinct().filter("doc_id % 3 = 0").selectExpr(*_split(_IMAGE))


def _split(columns: str) -> list[str]:
    """Top-level columns of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_B = f"WITH {LINES_SQL}, block AS (SELECT {_PLACE} FROM lines), image AS (SELECT {_IMAGE} FROM (SELECT DISTINCT doc_id, page_index FROM block WHERE doc_id % 3 = 0)) "
_BARE = "trim(text, chr(32) || chr(9) || chr(13) || chr(10))"
_NORMAL = rf"lower(regexp_replace(regexp_replace(regexp_replace({_BARE}, '\s+', ' ', 'g'), '(?i)\bpage\s+\d+\b', 'page #', 'g'), '^\d+$', '#'))"
_PATTERN = rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BARE}, '\s+', ' ', 'g'), '(?i)\bpage\s+\d+\b', 'PAGE_NUM', 'g'), '^\d+$', 'NUM_ONLY'), '(?i)\b\d{{1,3}}\s*of\s*\d{{1,3}}\b', 'PAGE_RANGE', 'g'))"


def _edge(share: float, normal: str, longest: int, name: str) -> str:
    return f"{name} AS (SELECT doc_id, page_index, block_no, line FROM (SELECT *, {normal} AS line, min(least(y0, y1)) OVER w AS low, max(greatest(y0, y1)) OVER w AS high FROM block WINDOW w AS (PARTITION BY doc_id, page_index)) WHERE (y1 < low + (high - low) * {share} OR y0 > high - (high - low) * {share}) AND length(line) BETWEEN 2 AND {longest})"


_EDGE = _edge(0.12, _NORMAL, 120, "edge")
_REPEAT = f"{_EDGE}, pages AS (SELECT doc_id, count(DISTINCT page_index) AS pages FROM block GROUP BY 1), repeating AS (SELECT doc_id, line, n FROM (SELECT doc_id, line, count(*) AS n FROM edge GROUP BY 1, 2) JOIN pages USING (doc_id) WHERE n >= pages * 0.8)"
_FRAG = f"CASE WHEN length({_BARE}) >= 80 THEN 0.0 END"  # blocks here are single lines, which are never fragmented
_PAGE = f"page AS (SELECT doc_id, page_index, count(*) AS n_blocks, sum(length(text)) + count(*) - 1 AS n_chars, count(*) >= 6 AND count(*) FILTER (length({_BARE}) >= 30) >= 6 AND count(*) FILTER (length({_BARE}) >= 30 AND x0 / 600.0 < 0.33) >= 3 AND count(*) FILTER (length({_BARE}) >= 30) - count(*) FILTER (length({_BARE}) >= 30 AND x0 / 600.0 < 0.33) >= 3 AS multi_column, coalesce(avg({_FRAG}), 0.0) AS fragmentation FROM block WHERE {_BARE} <> '' GROUP BY 1, 2), pages2 AS (SELECT p.*, coalesce(i.large_image, false) AS large_image, coalesce(i.n_images, 0) AS n_images FROM page p LEFT JOIN (SELECT doc_id, page_index, bool_or((x1 - x0) * (y1 - y0) / 480000.0 > 0.65) AS large_image, count(*) AS n_images FROM image GROUP BY 1, 2) i USING (doc_id, page_index))"
_GARB = r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]"
_DOC = f"""{_EDGE}, {_PAGE}, whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_index, block_no) AS t FROM block GROUP BY 1),
 doc AS (SELECT p.doc_id, page_count, avg_chars, avg_blocks, image_ratio, column_ratio, fragmentation, n_images,
  CASE WHEN len(regexp_extract_all(t, '\\S+')) > 0 THEN len(regexp_extract_all(t, '[A-Za-z][A-Za-z''\\-]+'))::DOUBLE / len(regexp_extract_all(t, '\\S+')) ELSE 0.0 END AS english,
  CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '{_GARB}', '', 'g')))::DOUBLE / length(t) ELSE 1.0 END AS garbled,
  len(regexp_extract_all(t, '(?i)\\(cid:\\d+\\)|cid:\\d+')) AS cid, regexp_matches(t, '(?i)\\breferences\\b') AS has_references, coalesce(r.repeated, 0) AS repeated
  FROM (SELECT doc_id, count(*) AS page_count, avg(n_chars) AS avg_chars, avg(n_blocks) AS avg_blocks, avg(large_image::INT) AS image_ratio, avg(multi_column::INT) AS column_ratio, avg(fragmentation) AS fragmentation, sum(n_images) AS n_images FROM pages2 GROUP BY 1) p JOIN whole w USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS repeated FROM (SELECT doc_id, line FROM edge GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1) r USING (doc_id))"""
_RULES = (("page_count = 0", "50", "NO_PAGES"), ("avg_chars < 500", "25", "FEW_CHARACTERS"), ("garbled > 0.01", "20", "GARBLED"), ("cid > 0", "least(20, cid * 2)", "CID_MARKERS"), ("english < 0.45", "15", "LITTLE_ENGLISH"), ("image_ratio > 0.35", "25", "LARGE_IMAGES"), ("column_ratio > 0.30", "15", "COLUMNS"), ("repeated > greatest(2, floor(page_count / 3))", "5", "REPEATED_LINES"), ("fragmentation > 0.55", "10", "FRAGMENTED"))
_SCORE = "greatest(0, least(100, 100 - (" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in _RULES) + ")))"
_LEVEL = "CASE WHEN score >= 90 THEN 'VERY_CLEAN' WHEN score >= 75 THEN 'CLEAN' WHEN score >= 60 THEN 'NEEDS_CLEANING' ELSE 'NOT_RECOMMENDED' END"
_PROBLEMS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _RULES) + "], lambda x: x IS NOT NULL), ',')"
_ADVICE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} {op} {x} THEN {quoted(t)} END" for n, op, x, t in L.ADVICE) + "], lambda x: x IS NOT NULL), ';')"

Q = Callable[[SparkSession, str], DataFrame]


def p1_columns(s, d):
    return L.column_counts(blocks(s, d))


def p2_reading_order(s, d):
    return L.reading_order(blocks(s, d))


def p3_repeating_lines(s, d):
    return L.repeating_lines(blocks(s, d))


def p4_without_repeating(s, d):
    b = blocks(s, d)
    return L.without_repeating(b, L.repeating_lines(b)).select("doc_id", "page_index", "block_no")


def p5_without_images(s, d):
    return L.without_images(blocks(s, d), images(s, d)).select("doc_id", "page_index", "block_no")


def p6_without_patterns(s, d):
    return L.without_patterns(blocks(s, d)).select("doc_id", "page_index", "block_no")


def p7_without_scraps(s, d):
    return L.without_scraps(blocks(s, d)).select("doc_id", "page_index", "block_no")


def p8_document_metrics(s, d):
    return L.document_metrics(blocks(s, d), images(s, d))


def p9_multi_column(s, d):
    return L.page_metrics(blocks(s, d), images(s, d)).select("doc_id", "page_index", "multi_column")


def p10_fragmentation(s, d):
    return bodies(s, d).select("doc_id", L.fragmented(F.col("body")).alias("fragmented"))


def p11_large_images(s, d):
    return L.page_metrics(blocks(s, d), images(s, d)).select("doc_id", "page_index", "large_image")


def _clean(s, d):
    return L.cleanliness(L.document_metrics(blocks(s, d), images(s, d)))


def p12_score(s, d):
    return _clean(s, d).select("doc_id", "score", F.array_join("problems", ",").alias("problems"))


def p13_level(s, d):
    return _clean(s, d).select("doc_id", "level", "accepted")


def p14_tables(s, d):
    return L.tables(blocks(s, d))


def _pages(s, d):
    return blocks(s, d).groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ").alias("text"))


def p15_joined_pages(s, d):
    return L.joined_pages(_pages(s, d).filter("trim(text) <> ''"))


def p16_fitting_size(s, d):
    b, size = blocks(s, d), F.col("x1") - F.col("x0")
    return b.select("doc_id", "page_index", "block_no", L.fitting_size(F.col("text"), F.upper(F.concat("text", F.lit(" "), "text")), size, (F.col("y1") - F.col("y0")) * 3).alias("size"))


def p17_fuzzy_lookup(s, d):
    docs = bodies(s, d)
    known = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("place"), F.col("body").alias("source"), F.md5("body").alias("target"))
    wanted = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat("body", F.lit(" more"))).otherwise(F.col("body")).alias("text"))
    return L.fuzzy_lookup(wanted, known).select("id", "tier", "target")


def p18_page_blocks(s, d):
    return L.page_blocks(blocks(s, d), images(s, d)).select("doc_id", "order", "page_index", "block_no")


def p19_advice(s, d):
    return _clean(s, d).select("doc_id", F.array_join("advice", ";").alias("advice"))


def queries() -> dict[str, Q]:
    return {f.__name__: f for f in (p1_columns, p2_reading_order, p3_repeating_lines, p4_without_repeating, p5_without_images, p6_without_patterns, p7_without_scraps, p8_document_metrics, p9_multi_column, p10_fragmentation, p11_large_images, p12_score, p13_level, p14_tables, p15_joined_pages, p16_fitting_size, p17_fuzzy_lookup, p18_page_blocks, p19_advice)}


_OPEN = r"length(text) >= 50 AND NOT regexp_matches(tail, '[.!?]\s*$') AND (regexp_matches(tail, '(?i)\b(" + L.OPEN_WORDS + r")\s*$') OR regexp_matches(tail, '[\p{Ll}-]$') OR (NOT regexp_matches(tail, '[.!?\"'')】》]$') AND len(regexp_split_to_array(tail, '\s+')) > 3))"
_GOES = r"length(text) >= 20 AND (regexp_matches(text, '^\p{Ll}') OR regexp_matches(text, '(?i)^(" + L.GOING_ON + ")'))"
_ID = "SELECT doc_id, page_index, block_no FROM block b WHERE "
_FIRST5 = r"array_to_string(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')[1:5], ' ')"


def oracle_sql() -> dict[str, str]:
    doc = f"{_B}, {_DOC}, scored AS (SELECT *, {_SCORE} AS score FROM doc) "
    return {
        "p1_columns": _B + f", n AS (SELECT doc_id, page_index, count(*) AS n FROM block GROUP BY 1, 2), c AS (SELECT doc_id, page_index, (x0 + x1) / 2 / 600.0 AS x, count(*) OVER (PARTITION BY doc_id, page_index ORDER BY (x0 + x1) / 2 / 600.0 RANGE BETWEEN 0.15 PRECEDING AND 0.15 FOLLOWING) AS k, count(*) OVER (PARTITION BY doc_id, page_index) AS m FROM block WHERE length({_BARE}) >= 30), g AS (SELECT doc_id, page_index, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY doc_id, page_index ORDER BY x) > 0.15, true) THEN 1 ELSE 0 END AS new FROM c WHERE k >= 3 AND m >= 6) SELECT n.doc_id, n.page_index, CASE WHEN n < 6 THEN 1 ELSE greatest(1, coalesce(f, 1)) END AS n_columns FROM n LEFT JOIN (SELECT doc_id, page_index, sum(new) AS f FROM g GROUP BY 1, 2) f USING (doc_id, page_index)",
        "p2_reading_order": _B + ", y AS (SELECT *, (y0 + y1) / 2 AS y FROM block), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page_index ORDER BY y, block_no) > 15 THEN 1 ELSE 0 END AS new FROM y), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY y, block_no ROWS UNBOUNDED PRECEDING) AS row FROM g), f AS (SELECT *, first_value(y0) OVER (PARTITION BY doc_id, page_index, row ORDER BY block_no) AS first FROM r) SELECT doc_id, page_index, block_no, row, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY first DESC, row, x0, block_no) AS place FROM f",
        "p3_repeating_lines": _B + f", {_REPEAT} SELECT doc_id, line, n FROM repeating",
        "p4_without_repeating": _B + f", {_REPEAT} {_ID} NOT EXISTS (SELECT 1 FROM repeating r WHERE r.doc_id = b.doc_id AND starts_with({_NORMAL}, r.line))",
        "p5_without_images": _B + _ID + "NOT EXISTS (SELECT 1 FROM image i WHERE i.doc_id = b.doc_id AND i.page_index = b.page_index AND greatest(0, least(i.x1, b.x1) - greatest(i.x0, b.x0)) * greatest(0, least(i.y1, b.y1) - greatest(i.y0, b.y0)) / greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1) > 0.3)",
        "p6_without_patterns": _B + f", {_edge(0.10, _PATTERN, 150, 'edge')}, pages AS (SELECT doc_id, count(DISTINCT page_index) AS pages FROM block GROUP BY 1), often AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM edge WHERE line NOT IN ('page_num', 'num_only', 'page_range') GROUP BY 1, 2) JOIN pages USING (doc_id) WHERE n >= greatest(2, floor(pages * 0.6))) {_ID} NOT EXISTS (SELECT 1 FROM often o WHERE o.doc_id = b.doc_id AND o.line = {_PATTERN})",
        "p7_without_scraps": _B + _ID + f"length({_BARE}) >= 2",
        "p8_document_metrics": doc + "SELECT doc_id, page_count, avg_chars, avg_blocks, image_ratio, column_ratio, fragmentation, n_images, english, garbled, cid, has_references, repeated FROM doc",
        "p9_multi_column": _B + f", {_PAGE} SELECT doc_id, page_index, multi_column FROM pages2",
        "p10_fragmentation": f"WITH {BODY_SQL}, b AS (SELECT doc_id, trim(body, chr(32) || chr(9) || chr(13) || chr(10)) AS t FROM body), r AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM b) SELECT doc_id, CASE WHEN length(t) >= 80 THEN len(l) >= 4 AND len(list_filter(l, lambda x: length(x) < 55))::DOUBLE / len(l) > 0.65 END AS fragmented FROM r",
        "p11_large_images": _B + f", {_PAGE} SELECT doc_id, page_index, large_image FROM pages2",
        "p12_score": doc + f"SELECT doc_id, score::DOUBLE AS score, {_PROBLEMS} AS problems FROM scored",
        "p13_level": doc + f"SELECT doc_id, {_LEVEL} AS level, score >= 75 AND avg_chars >= 500 AND garbled <= 0.01 AND cid = 0 AND image_ratio <= 0.35 AND column_ratio <= 0.30 AS accepted FROM scored",
        "p15_joined_pages": _B + f", p AS (SELECT doc_id, page_index, trim(string_agg(text, ' ' ORDER BY block_no)) AS text FROM block GROUP BY ALL), q AS (SELECT *, trim(CASE WHEN length(text) > 200 THEN right(text, 200) ELSE text END) AS tail FROM p WHERE text <> ''), o AS (SELECT *, {_OPEN} AS open_, {_GOES} AS goes FROM q), b AS (SELECT *, CASE WHEN coalesce(lag(open_) OVER w, false) AND goes THEN 0 ELSE 1 END AS brk FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)), r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT doc_id, min(page_index) AS first_page, max(page_index) AS last_page, string_agg(text, ' ' ORDER BY page_index) AS text FROM r GROUP BY doc_id, run",
        "p17_fuzzy_lookup": f"WITH {BODY_SQL}, known AS (SELECT doc_id AS place, body AS source, md5(body) AS target FROM body WHERE doc_id % 3 = 0), wanted AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN body || ' more' ELSE body END AS text FROM body), hit AS (SELECT id, 1 AS tier, place, target FROM wanted JOIN known ON text = source UNION ALL SELECT id, 2, place, target FROM wanted JOIN known ON length(text) > 50 AND starts_with(source, left(text, (length(text) // 2)::INT)) UNION ALL SELECT id, 3, place, target FROM wanted JOIN known ON length(text) > 50 AND ends_with(source, right(text, (length(text) - length(text) // 2)::INT)) UNION ALL SELECT id, 4, place, target FROM wanted JOIN known ON {_FIRST5.format('text')} = {_FIRST5.format('source')}) SELECT w.id, h.tier, h.target FROM wanted w LEFT JOIN (SELECT id, tier, target, row_number() OVER (PARTITION BY id ORDER BY tier, place) AS k FROM hit) h ON w.id = h.id AND k = 1",
        "p19_advice": doc + f"SELECT doc_id, {_ADVICE} AS advice FROM scored",
    }
