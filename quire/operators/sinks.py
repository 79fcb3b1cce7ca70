"""Sinks: finished chunks and blocks put together as documents, logs and reports, in order.

Each gives a row for each document; :func:`quire.sources.files.write_texts` writes such rows as files.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.blocks import tree_of


def _joined(rows: DataFrame, owner: str, order: str, text: Column, glue: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(owner).agg(F.array_join(F.transform(parts, lambda x: x["t"]), glue).alias("content"))


def translated(chunks: DataFrame, draft: bool, owner: str = "project_id", order: str = "chunk_order") -> DataFrame:
    """K1, K5: restored texts in order; a missing one is a comment in a draft, and left out else."""
    missing = F.concat(F.lit("<!-- TODO: "), F.col("id").cast("string"), F.lit(" -->")) if draft else F.lit(None).cast("string")
    return _joined(chunks, owner, order, F.coalesce("restored_text", missing), "\n\n")


def bilingual(chunks: DataFrame, owner: str = "project_id", order: str = "chunk_order") -> DataFrame:
    """K2: source and translation of each chunk, with rules between."""
    pair = F.concat(F.lit("## Source: "), F.col("id").cast("string"), F.lit("\n\n"), F.col("source_text"), F.lit("\n\n## Translation: "), F.col("id").cast("string"), F.lit("\n\n"), F.coalesce("restored_text", F.lit("")))
    return _joined(chunks, owner, order, pair, "\n\n---\n\n")


LOG = ("id", "chunk_order", "status", "retry_count", "error_message", "model_name", "prompt_version", "glossary_version", "block_ids")


def log(chunks: DataFrame) -> DataFrame:
    """K3: a JSON row for each chunk; columns that are absent are left out."""
    return chunks.select("project_id", "chunk_order", F.to_json(F.struct(*(c for c in LOG if c in chunks.columns))).alias("entry"))


def report_table(reports: DataFrame) -> DataFrame:
    """K4: a Markdown row for each report, its issue types joined or a dash."""
    issues = F.coalesce(F.nullif(F.array_join("issues", "; "), F.lit("")), F.lit("-"))
    return reports.select("project_id", "id", F.concat(F.lit("| "), F.col("chunk_id").cast("string"), F.lit(" | "), F.col("status"), F.lit(" | "), issues, F.lit(" |")).alias("row"))


def cells(blocks: DataFrame, parts: DataFrame, draft: bool) -> DataFrame:
    """K6: (doc_id, pos, text) of notebook cells from parts (doc_id, pos, part, n_parts, restored_text).

    A cell is replaced only if all its parts are there; else its source stays, marked in a draft.
    """
    done = parts.groupBy("doc_id", "pos").agg(F.max("n_parts").alias("n"), F.count("restored_text").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "restored_text"))), lambda x: x["restored_text"]), "\n\n").alias("new"))
    both = blocks.join(done, ["doc_id", "pos"], "left")
    todo = F.concat(F.lit("<!-- TODO -->\n"), F.col("text")) if draft else F.col("text")
    return both.select("doc_id", "pos", F.when(F.col("n").isNull(), F.col("text")).when(F.col("n") == F.col("k"), F.col("new")).otherwise(todo).alias("text"))


def spliced(text: Column, changes: Column) -> Column:
    """K8: a text with spans replaced; changes: array of (start, end, text) that don't overlap."""
    kind = "struct<at:int,out:string>"
    order = F.array_sort(changes)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), x["text"]).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(order, zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def spliced_documents(docs: DataFrame, changes: DataFrame, text_col: str = "text") -> DataFrame:
    """K8: documents with their changes (doc_id, start, end, text) put in; without any they stay."""
    rows = changes.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")).alias("__changes"))
    both = docs.join(rows, "doc_id", "left")
    return both.withColumn(text_col, F.when(F.col("__changes").isNotNull(), spliced(F.col(text_col), F.col("__changes"))).otherwise(F.col(text_col))).drop("__changes")


def rewritten_page(html: str, texts: dict[int, str]) -> str:
    """K7, K9: a page with text nodes replaced by number, where the parser found them; white space around them is kept."""
    out, at = [], 0
    for index, (start, end) in enumerate(tree_of(html).spans):
        if texts.get(index) is not None:
            raw = html[start:end]
            lead, tail = raw[: len(raw) - len(raw.lstrip())], raw[len(raw.rstrip()) :]
            out += [html[at:start], lead, escape(texts[index], quote=False), tail]
            at = end
    return "".join(out) + html[at:]


def rewritten_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """K7, K9: (doc_id, html) of pages (doc_id, html) with nodes (doc_id, node, text) replaced."""
    rows = nodes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("int"), "text"))).alias("texts"))
    both = pages.join(rows, "doc_id", "left").select("doc_id", "html", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.as_py() if not t.is_valid or x.as_py() is None else rewritten_page(x.as_py(), dict(t.as_py())) for x, t in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "html"])

    return both.mapInArrow(run, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, html string")


def block_texts(chunks: DataFrame) -> DataFrame:
    """(block_id, text): a chunk's text dealt to its blocks, by paragraphs where they are as many."""
    parts = F.split("restored_text", r"\n\n", -1)
    whole = F.size("block_ids") == 1
    even = F.size(parts) == F.size("block_ids")
    rows = chunks.filter("restored_text is not null").select(F.posexplode("block_ids").alias("k", "block_id"), F.when(whole, F.array("restored_text")).when(even, parts).alias("parts"))
    return rows.select("block_id", F.try_element_at("parts", F.col("k") + 1).alias("text"))
