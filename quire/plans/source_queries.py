"""Text sources as queries: every conversation is written as a file of the format and read back.

A conversation is a file of bounded size by nature, so no unbounded group meets in a row. Files lie in a folder
for each conversation in the shared folder, as Spark's text writer closes them, with a line end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.plans.common import quoted, table
from quire.sources import files as S


def _cue() -> Column:
    minute = F.lpad(F.col("turn").cast("string"), 2, "0")
    return F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:"), minute, F.lit(":00,000 --> 00:"), minute, F.lit(":59,000\n"), "text")


#: a turn's text in a file of the format, in Spark and in SQL, what parts them, and what a file begins with
_FORMATS = {
    "s2_markdown": (lambda: F.concat(F.lit("## "), "role", F.lit("\n\n"), "text"), "'## ' || role || chr(10) || chr(10) || text", "\n\n", "# Conversation\n\n"),
    "s3_plain_text": (lambda: F.concat("role", F.lit(": "), "text"), "role || ': ' || text", "\n", "\ufeff"),
    "s6_latex": (lambda: F.concat(F.lit("\\section{"), "role", F.lit("}\n"), "text"), "'\\section{' || role || '}' || chr(10) || text", "\n\n", "\\title{Conversation}\n"),
    "s7_subtitles": (_cue, "(turn + 1) || chr(10) || '00:' || lpad(turn::VARCHAR, 2, '0') || ':00,000 --> 00:' || lpad(turn::VARCHAR, 2, '0') || ':59,000' || chr(10) || text", "\n\n", ""),
}


def _ordered(rows: DataFrame, value: Column) -> DataFrame:
    """(conv_id, values in the order of turns)."""
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", value.alias("value"))))["value"].alias("values"))


def _read_back(files: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """(conv_id, text) of files (conv_id, text) after they were written."""
    spark, path = files.sparkSession, S.scratch(files.sparkSession)
    S.write_texts(files, path, "conv_id", "text")
    found = read(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", r"/name=(-?\d+)/", 1).cast("long").alias("conv_id"), "text")


def _text_files(name: str) -> Callable[[SparkSession, str], DataFrame]:
    turn, _, between, first = _FORMATS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _ordered(table(spark, sf_dir, "conversations"), turn())
        return _read_back(rows.select("conv_id", F.concat(F.lit(first), F.array_join("values", between)).alias("text")), S.read_texts)

    return query


def s8_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks with a cell for each turn, markdown for the user's and code for the others'."""
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code")
    rows = _ordered(table(spark, sf_dir, "conversations"), F.struct(kind.alias("cell_type"), F.col("text").alias("source")))
    files = rows.select("conv_id", F.to_json(F.struct(F.col("values").alias("cells"))).alias("text"))
    return B.parsed(_read_back(files, S.read_notebooks), B.notebook, id_col="conv_id").select("conv_id", "pos", "kind", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text_files(name) for name in _FORMATS} | {"s8_notebooks": s8_notebooks}


def _chars(text: str) -> str:
    return " || ".join(quoted(x) if x != "\n" else "chr(10)" for x in text) or "''"


def oracle_sql() -> dict[str, str]:
    # a byte order mark goes when a file is read
    found = {name: f"SELECT conv_id, {_chars(first.removeprefix(chr(0xFEFF)))} || string_agg({turn}, {_chars(between)} ORDER BY turn, role, text) || chr(10) AS text FROM conversations GROUP BY 1" for name, (_, turn, between, first) in _FORMATS.items()}
    found["s8_notebooks"] = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, CASE WHEN role = 'user' THEN 'markdown_cell' ELSE 'code_cell' END AS kind, text FROM conversations"
    return found
