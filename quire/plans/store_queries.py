"""Queries and SQL of the store and its read model (Q1 to Q24, R1 to R8), on tables laid over the given ones.

project: customer; chunk: the orders above a price, so some projects have none; block: line items;
report and attempt: labels and events, dealt to chunks by their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import readmodel as R
from quire.operators import store as S
from quire.plans.common import table

VIEWS = {
    "project": "SELECT c_custkey AS id, c_name AS name, c_name || '.md' AS source_file_name, lower(c_mktsegment) AS input_format, CASE c_custkey % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'FAILED' ELSE 'COMPLETED' END AS status, c_custkey % 97 AS updated_at FROM customer",
    "chunk": "SELECT o_orderkey AS id, o_custkey AS project_id, o_orderkey AS chunk_order, CASE WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE 'NEED_REVIEW' END AS status, o_orderpriority AS source_text, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) END AS target_text, o_orderkey % 4 AS retry_count FROM orders",
    "block": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS chunk_id, o_custkey AS project_id, l_linenumber AS block_order, l_returnflag AS block_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "report": "SELECT doc_id AS id, o_custkey AS project_id, o_orderkey AS chunk_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS status, doc_id AS created_at FROM labels JOIN orders ON o_orderkey = doc_id * 3 + 1",
    "attempt": "SELECT event_id AS id, o_custkey AS project_id, o_orderkey AS chunk_id, event_type AS status, event_id % 50 AS created_at, props AS prompt_preview FROM events JOIN orders ON o_orderkey = event_id",
    "span": "SELECT l_orderkey AS chunk_id, 'p' || CAST(l_linenumber AS VARCHAR(9)) AS placeholder, l_linenumber * 7 AS start_offset FROM lineitem WHERE l_returnflag = 'R'",
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views as DataFrames; chunk gets its block ids."""
    base = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "labels", "events")}
    out = {}
    for name, sql in VIEWS.items():
        out[name] = spark.sql(_named(sql, base), **base)
    ids = out["block"].groupBy(F.col("chunk_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("block_ids"))
    out["chunk"] = out["chunk"].join(ids, "id", "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<bigint>")))
    return out


def _named(sql: str, names: dict) -> str:
    for n in names:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n}", f"{word} {{{n}}}")
    return sql


_WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items() if k != "chunk")
_WITH += f", chunk_ AS ({VIEWS['chunk']}), chunk AS (SELECT c.*, coalesce((SELECT list(b.id ORDER BY b.id) FROM block b WHERE b.chunk_id = c.id), []) AS block_ids FROM chunk_ c) "
_COUNTS = "(SELECT project_id, count(*) AS n_chunks, count(*) FILTER (status = 'DONE') AS n_done, count(*) FILTER (status IN ('FAILED', 'NEED_REVIEW')) AS n_bad, count(*) FILTER (status = 'PENDING') AS n_pending FROM chunk GROUP BY 1)"
_LIST = f"SELECT p.id, name, status, updated_at, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_done, 0) AS n_done, coalesce(n_bad, 0) AS n_bad FROM project p LEFT JOIN {_COUNTS} c ON p.id = c.project_id"
_DASH = f"SELECT p.id, name, status, input_format, updated_at, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_done, 0) AS n_done, coalesce(n_bad, 0) AS n_bad, coalesce(n_pending, 0) AS n_pending, (SELECT count(*) FROM report r WHERE r.project_id = p.id AND r.status = 'FAIL') AS n_failed_reports, (SELECT count(*) FROM block b WHERE b.project_id = p.id) AS n_blocks, (SELECT count(*) FROM attempt a WHERE a.project_id = p.id) AS n_attempts FROM project p LEFT JOIN {_COUNTS} c ON p.id = c.project_id"
_CHUNKS = "SELECT id, project_id, chunk_order, status, length(coalesce(source_text, '')) AS source_text_length, length(coalesce(target_text, '')) AS target_text_length, len(block_ids) AS n_blocks, (SELECT count(*) FROM span s WHERE s.chunk_id = c.id) AS n_spans, (SELECT count(*) FROM report r WHERE r.chunk_id = c.id) AS n_reports, (SELECT count(*) FROM attempt a WHERE a.chunk_id = c.id) AS n_attempts FROM chunk c"
_CHUNK = ("id", "project_id", "chunk_order", "status", "source_text", "target_text", "retry_count")
_C = ", ".join(_CHUNK)
_DELTA = "(SELECT id, project_id, chunk_order, 'DONE' AS status, source_text, 'new' AS target_text, 0 AS retry_count FROM chunk WHERE id % 5 = 0 UNION ALL SELECT -id, project_id, chunk_order, 'PENDING', 'added', NULL, 0 FROM chunk WHERE id % 7 = 0)"


def _delta(chunk: DataFrame) -> DataFrame:
    lit = F.lit
    old = chunk.filter("id % 5 = 0").select("id", "project_id", "chunk_order", lit("DONE").alias("status"), "source_text", lit("new").alias("target_text"), lit(0).cast("bigint").alias("retry_count"))
    new = chunk.filter("id % 7 = 0").select((-F.col("id")).alias("id"), "project_id", "chunk_order", lit("PENDING").alias("status"), lit("added").alias("source_text"), lit(None).cast("string").alias("target_text"), lit(0).cast("bigint").alias("retry_count"))
    return old.unionByName(new)


def _plain(chunk: DataFrame) -> DataFrame:
    return chunk.select(*_CHUNK)


def _first_chunk(t: dict[str, DataFrame]):
    return t["chunk"].agg(F.min("id")).first()[0]


_KEYS = {"chunk": "status", "block": "block_type", "report": "status", "attempt": "status", "project": "status"}

#: name: (query over the tables, SQL after the views)
QUERIES: dict[str, tuple[Callable[[dict[str, DataFrame]], DataFrame], str]] = {
    "q1_project_list": (lambda t: R.project_list(t["project"], t["chunk"]), _LIST),
    "q2_dashboard": (lambda t: R.dashboard(t["project"], t["chunk"], t["report"], t["block"], t["attempt"]), _DASH),
    "q3_filtered_list": (lambda t: R.dashboard(t["project"], t["chunk"], t["report"], t["block"], t["attempt"], R.predicate("READY", "building", "r#0")), _DASH + " WHERE status = 'READY' AND input_format = 'building' AND (name ILIKE '%r#0%' OR p.id::VARCHAR ILIKE '%r#0%' OR source_file_name ILIKE '%r#0%')"),
    "q4_page_with_total": (lambda t: R.paged_with_total(t["project"].filter("status = 'FAILED'"), [F.desc("updated_at"), F.col("id")], 20, 40).select("id", "updated_at", "total"), "SELECT id, updated_at, (SELECT count(*) FROM project WHERE status = 'FAILED') AS total FROM project WHERE status = 'FAILED' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40"),
    "q5_chunk_list": (lambda t: R.chunk_list(t["chunk"], t["span"], t["report"], t["attempt"]), _CHUNKS),
    "q6_group_counts": (lambda t: _union(*(R.group_counts(t[n], k).withColumn("of", F.lit(n)) for n, k in _KEYS.items()), R.group_counts(t["project"], "input_format").withColumn("of", F.lit("format"))), " UNION ALL ".join(f"SELECT {k} AS key, count(*) AS n, '{n}' AS of FROM {n} GROUP BY 1" for n, k in _KEYS.items()) + " UNION ALL SELECT input_format, count(*), 'format' FROM project GROUP BY 1"),
    "q7_summary": (lambda t: R.summary(t["project"]), "SELECT count(*) AS n_projects, max(updated_at) AS latest FROM project"),
    "q8_chunk_detail": (lambda t: R.chunk_detail(t["chunk"], t["block"], t["report"], t["attempt"], t["span"], _first_chunk(t)).select("id", "status", *(F.size(c).alias(f"n_{c}") for c in ("blocks", "reports", "attempts", "spans")), F.array_join(F.transform("blocks", lambda x: x["id"].cast("string")), ",").alias("block_list")), "SELECT id, status, (SELECT count(*) FROM block b WHERE list_contains(c.block_ids, b.id)) AS n_blocks, (SELECT count(*) FROM report r WHERE r.chunk_id = c.id) AS n_reports, (SELECT count(*) FROM attempt a WHERE a.chunk_id = c.id) AS n_attempts, (SELECT count(*) FROM span s WHERE s.chunk_id = c.id) AS n_spans, array_to_string(block_ids, ',') AS block_list FROM chunk c WHERE id = (SELECT min(id) FROM chunk)"),
    "q9_blocks_in_order": (lambda t: R.numbered(t["block"], "project_id", [F.col("chunk_id"), F.col("block_order")], "place").select("id", "project_id", "place"), "SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY chunk_id, block_order) AS place FROM block"),
    "q10_chunks_by_status": (lambda t: R.by_status(t["chunk"], ("DONE", "FAILED")).select("id", "project_id", "status"), "SELECT id, project_id, status FROM chunk WHERE status IN ('DONE', 'FAILED')"),
    "q11_spans_in_order": (lambda t: R.numbered(t["span"], "chunk_id", [F.col("start_offset"), F.col("placeholder")], "place"), "SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY start_offset, placeholder) AS place FROM span"),
    "q12_terms_in_order": (lambda t: R.numbered(t["project"], "input_format", [F.desc("updated_at"), F.col("name")], "place").select("id", "input_format", "place"), "SELECT id, input_format, row_number() OVER (PARTITION BY input_format ORDER BY updated_at DESC, name) AS place FROM project"),
    "q13_reports_in_order": (lambda t: R.numbered(R.numbered(t["report"], "project_id", [F.col("created_at"), F.col("id")], "oldest"), "project_id", [F.desc("created_at"), F.desc("id")], "newest").select("id", "oldest", "newest"), "SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS oldest, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS newest FROM report"),
    "q14_workspaces": (lambda t: R.latest_first(t["project"].groupBy(F.col("input_format").alias("name")).agg(F.max(F.when(F.col("updated_at") > 90, F.col("updated_at").cast("string"))).alias("latest"))), "SELECT input_format AS name, max(CASE WHEN updated_at > 90 THEN updated_at::VARCHAR END) AS latest FROM project GROUP BY 1"),
    "q16_recent_projects": (lambda t: R.project_list(t["project"], t["chunk"]).limit(12), _LIST + " ORDER BY updated_at DESC, p.id LIMIT 12"),
    "q17_block_histogram": (lambda t: R.group_counts(t["block"], "block_type").orderBy("key"), "SELECT block_type AS key, count(*) AS n FROM block GROUP BY 1"),
    "q18_plan_statistics": (lambda t: R.plan_statistics(t["chunk"]), "SELECT project_id, count(*) AS n_chunks, sum(len(block_ids)) AS n_blocks, avg(len(block_ids)) AS mean_blocks FROM chunk GROUP BY 1"),
    "q19_retry_selection": (lambda t: _union(R.retry_selection(t["chunk"]).select("id", F.lit("open").alias("mode")), R.retry_selection(t["chunk"], True).select("id", F.lit("retry").alias("mode")), R.retry_selection(t["chunk"], True, True).select("id", F.lit("review").alias("mode"))), "SELECT id, 'open' AS mode FROM chunk WHERE status IN ('PENDING', 'FAILED') UNION ALL SELECT id, 'retry' FROM chunk WHERE status = 'FAILED' UNION ALL SELECT id, 'review' FROM chunk WHERE status IN ('FAILED', 'NEED_REVIEW')"),
    "q20_retry_reset": (lambda t: R.retry_reset(R.retry_selection(t["chunk"], True)).select("id", "status", "retry_count", "target_text"), "SELECT id, 'PENDING' AS status, 0 AS retry_count, NULL::VARCHAR AS target_text FROM chunk WHERE status = 'FAILED'"),
    "q21_outcome": (lambda t: R.outcome(t["chunk"]).select("project_id", "outcome"), "SELECT project_id, CASE WHEN bool_or(status IN ('PENDING', 'FAILED')) THEN 'FAILED' ELSE 'COMPLETED' END AS outcome FROM chunk GROUP BY 1"),
    "q22_draft": (lambda t: R.outcome(t["chunk"]).select("project_id", "draft"), "SELECT project_id, bool_or(status <> 'DONE') AS draft FROM chunk GROUP BY 1"),
    "q23_export_status": (lambda t: R.export_status(t["project"], R.outcome(t["chunk"])).select("id", "status"), "SELECT p.id, CASE WHEN d.draft = false THEN 'EXPORTED' ELSE p.status END AS status FROM project p LEFT JOIN (SELECT project_id, bool_or(status <> 'DONE') AS draft FROM chunk GROUP BY 1) d ON p.id = d.project_id"),
    "q24_new_reports": (lambda t: R.new_only(t["report"], t["report"].filter("id % 3 = 0")).select("id", "status"), "SELECT id, status FROM report WHERE id % 3 <> 0"),
    "r1_append": (lambda t: S.append(t["project"], t["project"].limit(0).unionByName(t["project"].filter("id = 1").withColumn("id", F.lit(-1).cast("bigint")))).select("id", "name"), "SELECT id, name FROM project UNION ALL SELECT -1, name FROM project WHERE id = 1"),
    "r2_update_status": (lambda t: S.update_status(t["project"], 1, "EXPORTED", 1000).select("id", "status", "updated_at"), "SELECT id, CASE WHEN id = 1 THEN 'EXPORTED' ELSE status END AS status, CASE WHEN id = 1 THEN 1000 ELSE updated_at END AS updated_at FROM project"),
    "r3_lookup": (lambda t: S.lookup(t["project"], 7).select("id", "name", "status"), "SELECT id, name, status FROM project WHERE id = 7"),
    "r4_replace": (lambda t: S.replace(_plain(t["chunk"]), _delta(t["chunk"])), f"SELECT {_C} FROM chunk WHERE project_id NOT IN (SELECT project_id FROM {_DELTA} d) UNION ALL SELECT {_C} FROM {_DELTA} d"),
    "r5_upsert": (lambda t: S.upsert(_plain(t["chunk"]), _delta(t["chunk"])), f"SELECT {_C} FROM chunk WHERE id NOT IN (SELECT id FROM {_DELTA} d) UNION ALL SELECT {_C} FROM {_DELTA} d"),
    "r6_patch": (lambda t: S.patch(_plain(t["chunk"]), _delta(t["chunk"]).select("id", "status", "target_text")), f"SELECT c.id, c.project_id, c.chunk_order, coalesce(d.status, c.status) AS status, c.source_text, coalesce(d.target_text, c.target_text) AS target_text, c.retry_count FROM chunk c LEFT JOIN {_DELTA} d ON c.id = d.id"),
    "r7_replace_spans": (lambda t: S.surviving(S.replace(t["span"], t["span"].filter("chunk_id % 2 = 0").withColumn("placeholder", F.lit("q")).distinct(), "chunk_id"), t["chunk"]), "SELECT chunk_id, placeholder, start_offset FROM (SELECT * FROM span WHERE chunk_id % 2 <> 0 UNION ALL SELECT DISTINCT chunk_id, 'q', start_offset FROM span WHERE chunk_id % 2 = 0) WHERE chunk_id IN (SELECT id FROM chunk)"),
    "r8_attempt_previews": (lambda t: S.with_preview(t["attempt"].withColumn("prompt_preview", F.repeat("prompt_preview", 40))).select("id", "prompt_preview"), "SELECT id, substring(repeat(prompt_preview, 40), 1, 1000) AS prompt_preview FROM attempt"),
}


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _run(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_tables(spark, sf_dir))


def q15_table_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the store's tables the folder has."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet"))
    return spark.createDataFrame([(n, bool(has(n))) for n in ("customer", "missing", "orders")], "name string, present boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(f) for k, (f, _) in QUERIES.items()} | {"q15_table_exists": q15_table_exists}


def oracle_sql() -> dict[str, str]:
    found = {k: _WITH + sql for k, (_, sql) in QUERIES.items()}
    return found | {"q15_table_exists": "SELECT * FROM (VALUES ('customer', true), ('missing', false), ('orders', true)) t(name, present)"}
