"""The relational read model over projects, chunks, blocks, reports and attempts.

Children are aggregated by their parent's key before they are joined, so a project with many chunks does
not fan out, and the aggregation is partial before the shuffle. Every list ends its order with a unique
key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, BAD = ("PENDING", "FAILED"), ("FAILED", "NEED_REVIEW")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    status = F.col("status")
    return chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"), count_if(status == "DONE", "n_done"), count_if(status.isin(*BAD), "n_bad"), count_if(status == "PENDING", "n_pending"))


def project_list(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q1: projects with their chunk counts, zero for those without chunks, newest first."""
    counts = chunk_counts(chunks).select(F.col("project_id").alias("id"), "n_chunks", "n_done", "n_bad")
    return projects.join(counts, "id", "left").select("id", "name", "status", "updated_at", zero("n_chunks"), zero("n_done"), zero("n_bad")).orderBy(F.desc("updated_at"), "id")


def predicate(status: str | None = None, input_format: str | None = None, text: str | None = None, columns: tuple[str, ...] = ("name", "id", "source_file_name")) -> Column:
    """Q3: equality filters and a case-insensitive search; % and _ in ``text`` stay wildcards."""
    parts = [F.lit(True)]
    if status:
        parts.append(F.col("status") == status)
    if input_format:
        parts.append(F.col("input_format") == input_format)
    if text:
        parts.append(functools.reduce(lambda a, b: a | b, (F.col(c).cast("string").ilike(f"%{text}%") for c in columns)))
    return functools.reduce(lambda a, b: a & b, parts)


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an ordered list; limits are those of the read interface."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500, offset 0 or more")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def dashboard(projects: DataFrame, chunks: DataFrame, reports: DataFrame, blocks: DataFrame, attempts: DataFrame, where: Column | None = None) -> DataFrame:
    """Q2: the project list with pending, failed-report, block and attempt counts."""
    by = lambda df, name: df.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias(name))
    out = projects.filter(F.lit(True) if where is None else where)
    out = out.join(chunk_counts(chunks).withColumnRenamed("project_id", "id"), "id", "left")
    for df, name in ((reports.filter("status = 'FAIL'"), "n_failed_reports"), (blocks, "n_blocks"), (attempts, "n_attempts")):
        out = out.join(by(df, name), "id", "left")
    names = ("n_chunks", "n_done", "n_bad", "n_pending", "n_failed_reports", "n_blocks", "n_attempts")
    return out.select("id", "name", "status", "input_format", "updated_at", *map(zero, names)).orderBy(F.desc("updated_at"), "id")


def chunk_list(chunks: DataFrame, spans: DataFrame, reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """Q5: chunks with text lengths instead of texts, and counts of what hangs on them."""
    by = lambda df, name: df.groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias(name))
    out = chunks
    for df, name in ((spans, "n_spans"), (reports, "n_reports"), (attempts, "n_attempts")):
        out = out.join(by(df, name), "id", "left")
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_length")
    return out.select("id", "project_id", "chunk_order", "status", length("source_text"), length("target_text"), F.size("block_ids").alias("n_blocks"), zero("n_spans"), zero("n_reports"), zero("n_attempts")).orderBy("chunk_order", "id")


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """Q6, Q17: rows by a key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def summary(projects: DataFrame) -> DataFrame:
    """Q7: how many projects, and the latest change."""
    return projects.agg(F.count("*").alias("n_projects"), F.max("updated_at").alias("latest"))


def chunk_detail(chunks: DataFrame, blocks: DataFrame, reports: DataFrame, attempts: DataFrame, spans: DataFrame, chunk_id) -> DataFrame:
    """Q8: one chunk with its blocks, reports, attempts and spans as ordered arrays."""
    one = chunks.filter(F.col("id") == chunk_id)
    wanted = one.select(F.explode("block_ids").alias("id"))
    own = lambda df, order, name: df.filter(F.col("chunk_id") == chunk_id).agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
    found = blocks.join(F.broadcast(wanted), "id", "left_semi").agg(F.sort_array(F.collect_list(F.struct("block_order", "id"))).alias("blocks"))
    out = one.select("id", "status")
    for part in (found, own(reports, ("created_at", "id"), "reports"), own(attempts, (-F.col("created_at").cast("long"), -F.col("id")), "attempts"), own(spans, ("start_offset", "placeholder"), "spans")):
        out = out.join(F.broadcast(part))  # one row each
    return out


def by_status(chunks: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Q10: chunks in order, of some states if given."""
    return (chunks if statuses is None else chunks.filter(F.col("status").isin(*statuses))).orderBy("project_id", "chunk_order", "id")


def plan_statistics(chunks: DataFrame) -> DataFrame:
    """Q18: chunks, blocks in them, and their mean."""
    size = F.size("block_ids")
    return chunks.groupBy("project_id").agg(F.count("*").alias("n_chunks"), F.sum(size).alias("n_blocks"), F.avg(size).alias("mean_blocks"))


def retry_selection(chunks: DataFrame, retry_failed: bool = False, review: bool = False) -> DataFrame:
    """Q19: PENDING and FAILED; only FAILED on retry; NEED_REVIEW too if asked."""
    states = {"FAILED"} if retry_failed else set(OPEN)
    return chunks.filter(F.col("status").isin(*states, *(["NEED_REVIEW"] if review else [])))


def retry_reset(chunks: DataFrame) -> DataFrame:
    """Q20: texts emptied, pending again, no attempts used."""
    return chunks.withColumns({"target_text": F.lit(None).cast("string"), "restored_text": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string"), "status": F.lit("PENDING"), "retry_count": F.lit(0)})


def outcome(chunks: DataFrame) -> DataFrame:
    """Q21, Q22: FAILED if a chunk is pending or failed, else COMPLETED; draft if any isn't done."""
    return chunks.groupBy("project_id").agg(F.when(F.bool_or(F.col("status").isin(*OPEN)), "FAILED").otherwise("COMPLETED").alias("outcome"), F.bool_or(F.col("status") != "DONE").alias("draft"))


def export_status(projects: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Q23: EXPORTED, but only for projects that are no draft."""
    out = projects.join(outcomes.select(F.col("project_id").alias("id"), "draft"), "id", "left")
    return out.withColumn("status", F.when(F.coalesce("draft", F.lit(True)), F.col("status")).otherwise("EXPORTED")).drop("draft")


def new_only(incoming: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Q24: rows whose key isn't stored."""
    return incoming.join(stored.select(key), key, "left_anti")


def paged_with_total(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Q4: a page with the count of all rows that match."""
    total = df.agg(F.count("*").alias("total"))
    return page(df.orderBy(*order), limit, offset).join(F.broadcast(total))  # one row


def latest_first(df: DataFrame) -> DataFrame:
    """Q14: by the latest change, then name, both falling; without a change last."""
    return df.orderBy(F.coalesce("latest", F.lit("")).desc(), F.col("name").desc())


def numbered(df: DataFrame, partition: str, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
