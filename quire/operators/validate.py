"""Validation of transformed chunks, documents and artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.mask import placeholders
from quire.functions.text import occurrences, strip, table_shape
from quire.operators.blocks import PAGE_SKIP, tree_of
from quire.operators.glossary import contains_term


def lost(a: Column, b: Column) -> Column:
    """V1: placeholders of a that b hasn't, sorted."""
    return F.array_sort(F.array_except(placeholders(a), placeholders(b)))


def empty_output(target: Column) -> Column:
    return strip(F.coalesce(target, F.lit(""))) == ""


def broken_fence(target: Column) -> Column:
    return occurrences(F.coalesce(target, F.lit("")), "```") % 2 == 1


def table_changed(source: Column, target: Column) -> Column:
    a, b = table_shape(F.coalesce(source, F.lit(""))), table_shape(F.coalesce(target, F.lit("")))
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def missing_terms(source: Column, target: Column, terms: Column) -> Column:
    """V5: terms (source_term, target_term, case_sensitive) of the source whose target term isn't in the target."""
    return F.filter(terms, lambda t: contains_term(source, t["source_term"], t["case_sensitive"]) & ~F.contains(F.coalesce(target, F.lit("")), t["target_term"]))


def chunk_issues(protected: Column, source: Column, target: Column, final: Column, terms: Column) -> Column:
    """V1 to V5: the types of a chunk's issues in order; a chunk without any passes."""
    checks = [
        (F.size(lost(protected, target)) > 0, "MISSING_PLACEHOLDER"),
        (F.size(lost(target, protected)) > 0, "EXTRA_PLACEHOLDER"),
        (empty_output(target), "EMPTY_OUTPUT"),
        (broken_fence(target), "BROKEN_CODE_FENCE"),
        (table_changed(source, target), "TABLE_SHAPE_CHANGED"),
    ]
    fixed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))
    return F.concat(fixed, F.transform(missing_terms(source, final, terms), lambda t: F.lit("TERM_MISSING")))


BRACKETS = ("()", "[]", "{}")


def docx_chunk_issues(source: Column, target: Column) -> Column:
    """V6: brackets, paragraphs, headings and length of a chunk against its source."""
    count = lambda x: F.size(F.filter(F.split(x, r"\n\s*\n"), lambda p: strip(p) != ""))
    heads = lambda x: F.regexp_count(x, F.lit(r"(?m)^#{1,6}\s"))
    uneven = [occurrences(target, b[0]) != occurrences(target, b[1]) for b in BRACKETS]
    delta = F.abs(count(source) - count(target))
    n, m = F.length(source), F.length(target)
    checks = [
        (F.greatest(*uneven), "UNBALANCED_BRACKETS"),
        (delta > F.greatest(F.lit(2.0), count(source) * 0.5), "PARAGRAPH_COUNT_CHANGED"),
        (heads(source) != heads(target), "HEADING_COUNT_CHANGED"),
        ((n > 0) & ((m < n * 0.1) | (m > n * 5)), "LENGTH_SUSPICIOUS"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in checks)))


def untranslated(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """V7: blocks that no finished chunk holds."""
    done = chunks.filter("status = 'DONE'").select(F.explode("block_ids").alias("id"))
    return blocks.join(done, "id", "left_anti")


def same_sequence(source: Column, target: Column, pattern: str) -> Column:
    """Whether a pattern's matches are equal in order."""
    every = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0))
    return every(source) == every(target)


#: fixed value: environment marks
ENVIRONMENT = r"\\(?:begin|end)\{[^}]+\}"
TIMING = r"(?:\d{2}:)?\d{2}:\d{2}[,.]\d{3}\s+-->\s+(?:\d{2}:)?\d{2}:\d{2}[,.]\d{3}"


def latex_issues(source: Column, target: Column) -> Column:
    """V10."""
    ends = lambda x: F.contains(x, F.lit(r"\end{document}"))
    checks = [(empty_output(target), "EMPTY_ARTIFACT"), (ends(source) & ~ends(target), "END_DOCUMENT_MISSING"), (~same_sequence(source, target, ENVIRONMENT), "ENVIRONMENT_CHANGED")]
    return F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in checks)))


def subtitle_issues(source: Column, target: Column) -> Column:
    """V11."""
    n = lambda x: F.regexp_count(x, F.lit(TIMING))
    head = lambda x: F.regexp_replace(x, "^\ufeff", "").startswith("WEBVTT")
    checks = [(n(source) != n(target), "CUE_COUNT_CHANGED"), (~same_sequence(source, target, TIMING), "TIMING_CHANGED"), (head(source) & ~head(target), "HEADER_MISSING")]
    return F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in checks)))


def html_issues(pairs: DataFrame, id_col: str = "doc_id", skips: frozenset = PAGE_SKIP) -> DataFrame:
    """V8, V9: (id, issues) of (id, source, target) pages or book files: attributes, text of ``skips``, node count."""
    def facts(html: str) -> tuple:
        tree = tree_of(html or "")
        kept = [t for s, t in tree.nodes if set(s) & skips]
        return tree.attributes, kept, sum(bool(t.strip()) for _, t in tree.nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1), batch.column(2), strict=True):
                (x, kept, n), (y, kept_y, m) = facts(a.as_py()), facts(b.as_py())
                found = ["ATTRIBUTES_CHANGED"] * (x != y) + ["PROTECTED_TEXT_CHANGED"] * (kept != kept_y) + ["NODE_COUNT_CHANGED"] * (abs(n - m) > max(3, 0.02 * n))
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=[id_col, "issues"])

    rows = pairs.select(id_col, "source", "target")
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, issues array<string>")


def notebook_issues(source: DataFrame, target: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, issues) from cells (id, pos, kind, text) before and after, matched by place."""
    b = target.select(F.col(id_col).alias("__id"), F.col("pos").alias("__pos"), F.col("kind").alias("kind_b"), F.col("text").alias("text_b"))
    both = source.join(b, (F.col(id_col) == F.col("__id")) & (F.col("pos") == F.col("__pos")), "full_outer")
    key = F.coalesce(id_col, "__id").alias(id_col)
    lone = F.col("kind").isNull() | F.col("kind_b").isNull()
    checks = [
        (F.bool_or(lone), "CELL_COUNT_CHANGED"),
        (F.bool_or(~lone & (F.col("kind") != F.col("kind_b"))), "CELL_TYPE_CHANGED"),
        (F.bool_or(~lone & (F.col("kind") != "markdown_cell") & ~F.col("text").eqNullSafe(F.col("text_b"))), "CELL_CONTENT_CHANGED"),
    ]
    return both.groupBy(key).agg(F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in checks))).alias("issues"))


def forced_draft(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether an artifact's failed report forces the draft form."""
    return reports.groupBy(key).agg(F.bool_or(F.col("status") == "FAIL").alias("draft"))
