"""Shared helpers: stage tables in the cluster's shared folder, table loading, defined nulls."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes of a row group of a stage table. A task holds the one it writes, so it isn't left at Parquet's 128 MB.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, an own one, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


class Stage:
    """Tables written to the shared folder, so that no later step depends on an executor's disk.

    Every table gets a fresh name: a retry of a job never meets the files of another run.
    ``drop`` removes a table that nothing reads any more, ``only`` all but those that a result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, set()
        self.root = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, packed: bool = True) -> DataFrame:
        """Write ``df`` and return the written table; without ``packed``, bytes that don't compress as they are."""
        self.names.add(name)
        writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
        (writer if packed else writer.option("compression", "none").option("parquet.enable.dictionary", "false")).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def only(self, *names: str) -> None:
        for name in sorted(self.names.difference(names)):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(conf).delete(path, True)


_HELD: dict = {}


def held(key: object, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps from task to task, such as a memo; one at a time.

    Workers live on from stage to stage. When a stage asks for another object, the one before goes, so a
    worker's memory is that of its largest stage and not of all it has run.
    """
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text (null id: crc32 of the empty text, 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
