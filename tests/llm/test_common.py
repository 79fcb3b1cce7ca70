"""The tables that stages hand on."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quire.llm.common import Stage


def test_a_task_holds_a_small_row_group(spark):
    """A task that writes many texts holds some 16 MB of them and not all of its rows; each row is written."""
    text = F.concat(*(F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(10)))
    rows = spark.range(0, 40_000, 1, 1).select("id", text.alias("text"))
    stage = Stage(spark, "groups")
    kept = stage.keep(rows, "rows")
    (path,) = Path(stage.path("rows").removeprefix("file:")).glob("*.parquet")
    meta = pq.ParquetFile(path).metadata
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert sum(sizes) > 40e6 and max(sizes) < 20e6
    assert kept.count() == 40_000 and kept.exceptAll(rows).isEmpty()
    stage.only()
