"""Order-dependent greedy packing of blocks into chunks and of chunks into batches.

A document's blocks are one sorted array, and packing is a fold over it, so documents pack in parallel and
no window or shuffle beyond the grouping by document is needed. The fold appends to an array, so its cost
grows with the square of a document's blocks; documents of more than some ten thousand blocks should be
cut before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import token_estimate, word_count

#: fixed values: limits in estimated tokens, and those of batches in characters and words
SOFT, MOST = 2200, 3000
SMALL_CHARS, BATCH_CHARS, SMALL_WORDS = 500, 3000, 100


def chunk_numbers(blocks: Column, soft: int = SOFT, most: int = MOST, overhead: int = 0, by_heading: bool = True) -> Column:
    """The chunk of each block of a sorted array of (text, heading); heading: its level, null for others.

    A heading of level 1 or 2 begins a chunk; so does a block that would pass ``soft``; a chunk that
    reaches ``most`` ends. ``overhead``: tokens that each block's marker costs.
    """
    kind = "struct<n:int,tokens:int,chunk:int,out:array<int>>"

    def step(acc: Column, x: Column) -> Column:
        cost = token_estimate(x["text"]) + overhead
        new = (acc["n"] > 0) & ((F.coalesce(x["heading"] <= 2, F.lit(False)) & F.lit(by_heading)) | (acc["tokens"] + cost > soft))
        chunk, tokens = acc["chunk"] + new.cast("int"), F.when(new, 0).otherwise(acc["tokens"]) + cost
        out, full = F.concat(acc["out"], F.array(chunk)), tokens >= most
        return F.struct(F.when(full, 0).otherwise(F.lit(1)).alias("n"), F.when(full, 0).otherwise(tokens).alias("tokens"), (chunk + full.cast("int")).alias("chunk"), out.alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out")).cast(kind)
    return F.aggregate(blocks, zero, step, lambda acc: acc["out"])


def planned(blocks: DataFrame, soft: int = SOFT, most: int = MOST, overhead: int = 0, by_heading: bool = True, owner: str = "doc_id") -> DataFrame:
    """(owner, pos, id, text, heading, chunk, chapter) of blocks with columns owner, pos, id, text, heading."""
    rows = blocks.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text", "heading"))).alias("blocks"))
    each = rows.withColumn("chunk", chunk_numbers(F.col("blocks"), soft, most, overhead, by_heading)).select(owner, F.explode(F.arrays_zip("blocks", "chunk")).alias("x"))
    flat = each.select(owner, "x.blocks.*", "x.chunk")
    so_far = Window.partitionBy(owner).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("chapter", F.last(F.when(F.col("heading") <= 2, F.col("id")), ignorenulls=True).over(so_far))


def chunks_of(plan: DataFrame, owner: str = "doc_id", marker: str | None = None) -> DataFrame:
    """(owner, chunk, chapter, block_ids, source_text) of a plan; ``marker``: a format of the block's place before each text."""
    text = F.col("text") if marker is None else F.concat(F.format_string(marker, F.col("pos") + 1), F.lit("\n"), F.col("text"))
    rows = plan.groupBy(owner, "chunk", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "id", text.alias("text")))).alias("b"))
    return rows.select(owner, "chunk", "chapter", F.col("b.id").alias("block_ids"), F.array_join(F.col("b.text"), "\n\n").alias("source_text"))


def is_small(text: Column) -> Column:
    return (word_count(text) < SMALL_WORDS) | (F.length(text) < SMALL_CHARS)


def batch_numbers(texts: Column, most: int = BATCH_CHARS) -> Column:
    """The batch of each of a sorted array of (n: characters, small): a large one stands alone."""
    kind = "struct<n:int,chars:int,batch:int,out:array<int>>"

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & (~x["small"] | (acc["chars"] + x["n"] > most))
        batch = acc["batch"] + new.cast("int")
        chars = F.when(new, 0).otherwise(acc["chars"]) + x["n"]
        out = F.concat(acc["out"], F.array(batch))
        alone = ~x["small"]
        return F.struct(F.when(alone, 0).otherwise(F.lit(1)).alias("n"), F.when(alone, 0).otherwise(chars).alias("chars"), (batch + alone.cast("int")).alias("batch"), out.alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out")).cast(kind)
    return F.aggregate(texts, zero, step, lambda acc: acc["out"])


def batched(chunks: DataFrame, owner: str, order: str, text: str, most: int = BATCH_CHARS) -> DataFrame:
    """``chunks`` (owner, order, text) with their batch."""
    rows = chunks.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.length(text).alias("n"), is_small(F.col(text)).alias("small")))).alias("t"))
    each = rows.withColumn("batch", batch_numbers(F.col("t"), most)).select(owner, F.explode(F.arrays_zip("t", "batch")).alias("x"))
    return each.select(owner, F.col("x.t.place").alias(order), F.col("x.t.n").alias("n"), F.col("x.t.small").alias("small"), F.col("x.batch").alias("batch"))


def batch_statistics(batches: DataFrame, owner: str) -> DataFrame:
    """Batches of an owner: chunks, batches, mean, most, least, single and multiple ones."""
    size = batches.groupBy(owner, "batch").agg(F.count("*").alias("k"))
    return size.groupBy(owner).agg(F.sum("k").alias("n_chunks"), F.count("*").alias("n_batches"), F.avg("k").alias("mean_size"), F.max("k").alias("most"), F.min("k").alias("least"), F.count_if(F.col("k") == 1).alias("singles"), F.count_if(F.col("k") > 1).alias("multis"))


def batch_parts(output: Column, sizes: Column, separator: str = "\n\n") -> Column:
    """C11: the batch's output cut at separators if the parts are as many; else in proportion to source sizes, the last takes the rest."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts, total = F.split(output, separator, -1), F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    share = F.transform(sizes, lambda x: F.when(total > 0, F.floor(F.length(output) * (x.cast("double") / total))).otherwise(F.floor(F.length(output) / F.size(sizes))).cast("int"))
    before = lambda i: F.aggregate(F.slice(share, 1, i), F.lit(0), lambda a, x: a + x)
    cut = F.transform(share, lambda x, i: trim(F.when(i == F.size(share) - 1, output.substr(before(i) + 1, F.length(output))).otherwise(output.substr(before(i) + 1, x))))
    return F.when(F.size(sizes) == 1, F.array(output)).when(F.size(parts) == F.size(sizes), F.transform(parts, trim)).otherwise(cut)


def cell_parts(text: str, soft: int = SOFT, most: int = MOST) -> list[str]:
    """C4: a notebook cell in parts of at most ``soft`` tokens where it passes ``most``: by paragraphs, large ones by lines."""
    cost = lambda x: max(1, len(x) // 4)

    def packed(units: list[str], glue: str) -> Iterator[str]:
        run, n = [], 0
        for unit in units:
            if run and n + cost(unit) > soft:
                yield glue.join(run)
                run, n = [], 0
            run.append(unit)
            n += cost(unit)
        if run:
            yield glue.join(run)

    if cost(text) <= most:
        return [text]
    parts: list[str] = []
    small: list[str] = []
    for unit in [*text.split("\n\n"), None]:
        if unit is not None and cost(unit) <= most:
            small.append(unit)
            continue
        parts += packed(small, "\n\n")
        small = []
        if unit is not None:
            parts += packed(unit.splitlines(keepends=True), "")
    return [x for x in parts if x.strip()] or [text]


def split_cells(cells: DataFrame, soft: int = SOFT, most: int = MOST) -> DataFrame:
    """A row for each part of (doc_id, pos, text), part from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), p.as_py(), k, x) for d, p, t in zip(*batch.columns, strict=True) for k, x in enumerate(cell_parts(t.as_py() or "", soft, most))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "pos", "part", "text"])

    return cells.select(F.col("doc_id").cast("long"), F.col("pos").cast("long"), "text").mapInArrow(run, "doc_id long, pos long, part int, text string")


def skips_batching(formats: Column, n: Column) -> Column:
    """No batching for marker formats, or for a single chunk."""
    return (n == 1) | F.coalesce(F.exists(formats, lambda x: x.isin("html", "latex", "srt", "vtt")), F.lit(False))
