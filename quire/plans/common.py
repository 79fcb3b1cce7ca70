"""Inputs that queries and their SQL share.

The given documents have no markup, so a fixed ending, chosen by the id, is appended to each text; SQL
appends the same. Lines are split at line feeds, as the given texts have no other line end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENDINGS = (
    "",
    "\nSee (cid:12) and (cid:7).",
    " (cid:3)(cid:4)(cid:5)(cid:6) (cid:1)(cid:2)(cid:8)(cid:9) (cid:10) (cid:11) (cid:13)",
    "\n\n# 1.2 Heading of it\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n- one\n- two\n\n> quoted",
    " `code x` https://example.org/a/b [link](docs/a.md) ![img](img/p.png) [12]",
    "\n```python\nimport os\nx = {1}\n```\nconfig = [1]; y = f('z');",
    " Abstract. References [12, 3] (Smith, 2020) a=b+c*d-e/f<g>h+i \ufffd\ue001\x01",
    "\npage 3\n17\n3 of 10\nChapter 2. Results\n\\section{Title} \\emph{x}",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def with_ending(text: Column, doc_id: Column) -> Column:
    chosen = F.element_at(F.array(*map(F.lit, ENDINGS)), (doc_id % len(ENDINGS) + 1).cast("int"))
    return F.concat(text, chosen)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body, lang, source, n_chars)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", with_ending(F.col("text"), F.col("doc_id")).alias("body"), "lang", "source", "n_chars")


BODY_SQL = f"body AS (SELECT doc_id, text || CASE doc_id % {len(ENDINGS)} {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(ENDINGS))} END AS body, lang, source, n_chars FROM documents)"


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line) of every line, pos from 0."""
    return bodies(spark, sf_dir).select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))


LINES_SQL = f"{BODY_SQL}, rows_ AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM body), lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM rows_)"
