"""The whole workflow as one plan: documents to blocks, chunks, masked text, model, restored text, report.

Nothing is collected between the steps; every step is a DataFrame over the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.mask import masked, restored
from quire.operators import chunks as C
from quire.operators import glossary as G
from quire.operators import validate as V


def chunked(blocks: DataFrame, soft: int, most: int) -> DataFrame:
    """(doc_id, chunk, chapter, block_ids, source_text)."""
    return C.chunks_of(C.planned(blocks, soft, most))


def run(blocks: DataFrame, terms: Column, soft: int = C.SOFT, most: int = C.MOST, replace=G.replaced) -> DataFrame:
    """Chunks with protected, target and restored text, issues and status.

    ``blocks``: (doc_id, pos, id, text, heading); ``terms``: array of (source_term, target_term,
    case_sensitive); ``replace(text, terms)`` stands in for the model.
    """
    rows = chunked(blocks, soft, most).withColumn("m", masked(F.col("source_text")))
    rows = rows.select("doc_id", "chunk", "chapter", "block_ids", "source_text", "m.protected", "m.spans")
    rows = rows.withColumn("target_text", replace(F.col("protected"), terms))
    rows = rows.withColumn("restored_text", restored(F.col("target_text"), F.col("spans")))
    rows = rows.withColumn("issues", V.chunk_issues(F.col("protected"), F.col("source_text"), F.col("target_text"), F.col("restored_text"), terms))
    return rows.withColumn("status", F.when(F.size("issues") == 0, "DONE").otherwise("FAILED"))


def issue_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by status and issue."""
    return chunks.select("status", F.explode_outer("issues").alias("issue")).groupBy("status", F.coalesce("issue", F.lit("-")).alias("issue")).agg(F.count("*").alias("n"))
