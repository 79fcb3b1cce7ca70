"""Writes of the store as set operations: each gives the table after the write.

Tables are written with :func:`replace_partitions`, which overwrites only the projects that are in the
given rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = 1000


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """R1, R8."""
    return table.unionByName(rows, allowMissingColumns=True)


def with_preview(attempts: DataFrame) -> DataFrame:
    """Prompts and responses are kept as previews."""
    cut = {c: F.substring(c, 1, PREVIEW) for c in ("prompt_preview", "response_preview") if c in attempts.columns}
    return attempts.withColumns(cut)


def update_status(projects: DataFrame, project_id, status: str, now) -> DataFrame:
    """R2; KeyError if there is no such project."""
    hit = F.col("id") == project_id
    if projects.filter(hit).isEmpty():
        raise KeyError(project_id)
    return projects.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def lookup(table: DataFrame, key, name: str = "id") -> DataFrame:
    """A point read, pushed to the scan."""
    return table.filter(F.col(name) == key)


def replace(table: DataFrame, rows: DataFrame, owner: str = "project_id") -> DataFrame:
    """All rows of the owners that occur in ``rows`` give way to ``rows``."""
    return table.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def surviving(children: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children of chunks that are still there, as a cascading delete leaves them."""
    return children.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Full rows by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The columns of ``changes`` that are not null replace those of the row; unknown keys do nothing."""
    columns = [c for c in changes.columns if c != key]
    out = table.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns)), key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*table.columns)


def replace_partitions(rows: DataFrame, path: str, owner: str = "project_id") -> None:
    """R4 on files: only the partitions of the given owners are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)
