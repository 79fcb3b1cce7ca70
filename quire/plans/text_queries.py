"""Queries and SQL of the text primitives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.common import BODY_SQL, LINES_SQL, bodies, line_rows

_GARBLED = r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]"
_WORDS = r"len(regexp_extract_all(body, '\S+'))"
_G = f"CASE WHEN length(body) > 0 THEN (length(body) - length(regexp_replace(body, '{_GARBLED}', '', 'g')))::DOUBLE / length(body) ELSE 1.0 END"
_KEPT = r"replace(replace(replace(replace(body, ' ', ''), chr(10), ''), chr(13), ''), chr(9), '')"
_P = rf"CASE WHEN length(body) > 0 THEN (length(body) - (length({_KEPT}) - length(regexp_replace({_KEPT}, '[\p{{C}}\p{{Z}}]', '', 'g'))))::DOUBLE / length(body) ELSE 0.0 END"
_M = rf"""CASE WHEN {_WORDS} > 0 THEN list_sum(list_transform(regexp_extract_all(body, '\S+'), lambda w: length(trim(w, '.,!?;:"'''))))::DOUBLE / {_WORDS} ELSE 0.0 END"""
_CID = r"len(regexp_extract_all(body, '\(cid:\d+\)'))"
_SEV = f"CASE WHEN {_CID} = 0 THEN 'none' WHEN {_CID} <= 3 THEN 'minor' WHEN {_CID} <= 10 THEN 'moderate' ELSE 'critical' END"
_NORMAL = r"regexp_replace(trim(line, chr(32) || chr(9) || chr(13)), '\s+', ' ', 'g')"
_LATEX = r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
_TRIMMED = "trim(line, chr(32) || chr(9) || chr(13))"
_has = lambda p: "contains(body, '" + p.replace("'", "''") + "')"
_eq = "(length(body) - length(replace(body, '=', '')))"
_CODE = f"""length(body) >= 10 AND (({_has('{')} AND {_has('}')} AND {_eq} >= 1) OR ({_has('[')} AND {_has(']')} AND {_eq} >= 1)
 OR (length(body) - length(replace(body, ';', '')) >= 2 AND {_eq} >= 1 AND ({_has('(')} OR {_has(')')}))
 OR ({_eq} >= 2 AND ({_has('("')} OR {_has('")')} OR {_has(",'")} OR {_has("')")}))
 OR ({_has(':')} AND {_has('(')} AND {_has(')')} AND NOT {_has('{')} AND NOT {_has('}')}))"""


def _by_text() -> dict[str, dict[str, Column]]:
    """Columns over the texts; made when asked for, as they need a session."""
    b, n = F.col("body"), F.col("n_chars")
    return {
        "t1_token_estimate": {"tokens": T.token_estimate(b)},
        "t2_word_count": {"words": T.word_count(b)},
        "t3_english_word_ratio": {"ratio": T.english_word_ratio(b)},
        "t4_garbled_ratio": {"ratio": T.garbled_ratio(b)},
        "t5_printable_ratio": {"ratio": T.printable_ratio(b)},
        "t6_mean_word_length": {"mean_length": T.mean_word_length(b)},
        "t7_cid_markers": {"n": T.count(b, T.CID), "n_loose": T.count(b, T.CID_LOOSE), "ratio": T.cid_ratio(b), "severity": T.cid_severity(T.count(b, T.CID))},
        "t8_cid_cleanup": {"cleaned": T.cid_cleaned(b)},
        "t9_text_quality": {"cid_count": T.quality(b)["cid_count"], "severity": T.quality(b)["severity"], "garbled": T.quality(b)["garbled_ratio"], "printable": T.quality(b)["printable_ratio"], "mean_length": T.quality(b)["avg_word_length"], "can_translate": T.quality(b)["can_translate"]},
        "t12_academic_marks": {k: T.academic_marks(b)[k] for k in ("has_abstract", "has_references", "has_formulas", "has_citations")},
        "t13_length_similarity": {"similarity": T.length_similarity(n, F.length(b))},
        "t14_has_letter": {"letter": T.has_letter(b)},
        "t16_looks_like_code": {"code": T.looks_like_code(b)},
        "t17_code_language": {"language": T.code_language(b)},
        "t19_unwrapped_markdown": {"plain": T.unwrapped(b)},
        "t21_table_shape": {"shape": F.array_join(T.table_shape(b).cast("array<string>"), ",")},
    }


def _by_line() -> dict[str, dict[str, Column]]:
    return {
        "t10_normal_line": {"normal": T.normal_line(F.col("line"))},
        "t11_normal_pattern": {"normal": T.normal_pattern(F.col("line"))},
        "t15_latex_text": {"translatable": T.latex_translatable(F.col("line")), "command_only": T.latex_command_only(F.col("line"))},
        "t20_heading_number": {"number": T.heading_number(F.col("line"))["number"], "title": T.heading_number(F.col("line"))["title"]},
    }


TEXT_SQL: dict[str, dict[str, str]] = {
    "t1_token_estimate": {"tokens": "greatest(1, length(body) // 4)"},
    "t2_word_count": {"words": _WORDS},
    "t3_english_word_ratio": {"ratio": rf"CASE WHEN {_WORDS} > 0 THEN len(regexp_extract_all(body, '[A-Za-z][A-Za-z''\-]+'))::DOUBLE / {_WORDS} ELSE 0.0 END"},
    "t4_garbled_ratio": {"ratio": _G},
    "t5_printable_ratio": {"ratio": _P},
    "t6_mean_word_length": {"mean_length": _M},
    "t7_cid_markers": {"n": _CID, "n_loose": r"len(regexp_extract_all(body, '(?i)\(cid:\d+\)|cid:\d+'))", "ratio": f"{_CID}::DOUBLE / greatest(1, {_WORDS})", "severity": _SEV},
    "t8_cid_cleanup": {"cleaned": r"regexp_replace(body, '\(cid:\d+\)', '[UNKNOWN_CHAR]', 'g')"},
    "t9_text_quality": {"cid_count": _CID, "severity": _SEV, "garbled": _G, "printable": _P, "mean_length": _M, "can_translate": f"({_SEV}) <> 'critical' AND ({_G}) < 0.1 AND ({_P}) > 0.8"},
    "t12_academic_marks": {"has_abstract": r"regexp_matches(body, '(?i)\babstract\b')", "has_references": r"regexp_matches(body, '(?i)\breferences\b')", "has_formulas": r"len(regexp_extract_all(body, '(?i)[=<>+\-*/]|sum|sqrt|log')) > 8", "has_citations": r"regexp_matches(body, '\[[0-9,\s-]{1,20}\]|\([A-Z][A-Za-z]+,\s+\d{4}\)')"},
    "t13_length_similarity": {"similarity": "CASE WHEN greatest(n_chars, length(body)) > 0 THEN least(n_chars, length(body))::DOUBLE / greatest(n_chars, length(body)) ELSE 0.0 END"},
    "t14_has_letter": {"letter": r"regexp_matches(body, '\p{L}')"},
    "t16_looks_like_code": {"code": _CODE},
    "t17_code_language": {"language": f"CASE WHEN {_has('def ')} OR {_has('import ')} OR {_has('class ')} THEN 'python' WHEN {_has('function ')} OR {_has('const ')} OR {_has('let ')} THEN 'javascript' WHEN {_has('{')} AND {_has('}')} AND {_has(';')} THEN 'c' ELSE 'python' END"},
    "t19_unwrapped_markdown": {"plain": r"array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(regexp_replace(regexp_replace(regexp_replace(s, '^\s{0,3}#{1,6}\s+', ''), '^\s*[-*]\s+', ''), '\*\*|__', '', 'g'), chr(32) || chr(9) || chr(13))), lambda s: s <> ''), chr(10))"},
    "t21_table_shape": {"shape": r"coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s)), lambda s: contains(s, '|') AND NOT regexp_matches(s, '^\|?\s*:?-{3,}:?')), lambda s: len(string_split(trim(s, '|'), '|'))), ','), '')"},
}
LINE_SQL: dict[str, dict[str, str]] = {
    "t10_normal_line": {"normal": rf"lower(regexp_replace(regexp_replace({_NORMAL}, '(?i)\bpage\s+\d+\b', 'page #', 'g'), '^\d+$', '#'))"},
    "t11_normal_pattern": {"normal": rf"lower(regexp_replace(regexp_replace(regexp_replace({_NORMAL}, '(?i)\bpage\s+\d+\b', 'PAGE_NUM', 'g'), '^\d+$', 'NUM_ONLY'), '(?i)\b\d{{1,3}}\s*of\s*\d{{1,3}}\b', 'PAGE_RANGE', 'g'))"},
    "t15_latex_text": {"translatable": rf"length({_TRIMMED}) >= 2 AND regexp_matches(regexp_replace({_TRIMMED}, '{_LATEX}', ' ', 'g'), '[A-Za-z\x{{C0}}-\x{{FFFF}}]')", "command_only": rf"regexp_replace(regexp_replace({_TRIMMED}, '{_LATEX}', '', 'g'), '[{{}}\\\s,.;:!?~&%$#_^*-]+', '', 'g') = ''"},
    "t20_heading_number": {"number": r"nullif(regexp_extract(line, '(?i)^(Chapter\s+\d+(?:\.\d+)*\.?|\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '')", "title": r"CASE WHEN regexp_matches(line, '(?i)^(Chapter\s+\d+(?:\.\d+)*\.?|\d+(?:\.\d+)*\.?)\s+(.+)$') THEN regexp_extract(line, '(?i)^(Chapter\s+\d+(?:\.\d+)*\.?|\d+(?:\.\d+)*\.?)\s+(.+)$', 2) ELSE line END"},
}


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bodies(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in _by_text()[name].items()))


def _line_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: line_rows(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), *(c.alias(k) for k, c in _by_line()[name].items()))


def t18_code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered scan of lines, so Arrow batches of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([T.code_fences(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "fenced"])

    return bodies(spark, sf_dir).select("doc_id", "body").mapInArrow(run, "doc_id long, fenced string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _text_query(k) for k in TEXT_SQL} | {k: _line_query(k) for k in LINE_SQL} | {"t18_code_fences": t18_code_fences}


def oracle_sql() -> dict[str, str]:
    columns = lambda x: ", ".join(f"{sql} AS {k}" for k, sql in x.items())
    found = {k: f"WITH {BODY_SQL} SELECT doc_id, {columns(v)} FROM body" for k, v in TEXT_SQL.items()}
    return found | {k: f"WITH {LINES_SQL} SELECT doc_id, pos, {columns(v)} FROM lines" for k, v in LINE_SQL.items()}
