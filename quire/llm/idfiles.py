"""Operator 3: token-id files with frequency-ranked ids in byte-aligned variable-length coding.

Layout of a block (one file image, little-endian), kept as one binary cell of a written table so that
Spark's committed writers put it on any file system:

    magic "QIV1" | uint32 number of documents | uint64 number of ids
    documents: int64 id, uint8 1 if the id is not null, uint32 number of ids
    control bytes: four 2-bit lengths (bytes - 1) each, the first id in the low bits
    data bytes: each id's rank in 1 to 4 bytes

A rank is an id's place by falling corpus frequency (ties: the smaller id first), so frequent ids take
one byte. Control and data bytes are apart: a reader looks up the lengths of four ids at once in a
table of 256 rows and gathers the data bytes with numpy, without a loop over ids.

Steps: (1) documents are dealt by ranges of ids (cut at quantiles of the column of ids), the only shuffle of their size, and tokenised once,
into a written table of blocks with plain ids; (2) ids are counted on the way, one table for each partition, into the rank table (at most the vocabulary's size,
broadcast); (3) each block is coded and written, in place; (4) the blocks are read back and decoded.
No step holds more than a block and one document. Lost executors only repeat their partitions.

Hot ids: an id that many rows have takes up several ranges, and so do null ids; its rows are dealt to them by ranges of the
text's hash, the order that they have anyway. Only rows of equal id and text stay together.

Null text: empty, so only the end id. Null ids come first. Equal ids are ordered by text hash, equal
rows stay repeated. Ids must be integers.
"""

from __future__ import annotations

import collections
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import Stage, whole_text
from quire.llm.pretoken import byte_pair_ids

#: Rows of a range of ids, about; there are as many ranges as shuffle partitions at least.
ROWS = 200_000
#: A block closes once it holds this many ids.
BLOCK = 1 << 18
#: Pre-tokens that a worker remembers.
MEMO = 1_200_000
MAGIC, HEAD = b"QIV1", struct.Struct("<4sIQ")
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")])

_BITS = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: Bytes of each of the four ids of a control byte.
LENGTHS = (_BITS + 1).astype(np.uint8)


def pack_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    more = np.zeros(-(-len(values) // 4) * 4, np.uint8)  # bytes of each value, less one
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        over = values > limit
        if not over.any():
            break
        more[: len(values)] += over.view(np.uint8)
    quads = more.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    more = more[: len(values)]
    end = np.cumsum(more + np.uint8(1), dtype=np.int64)
    start = end - more - 1
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    data[start] = values & np.uint32(255)
    for k in (1, 2, 3):
        at = np.flatnonzero(more >= k)
        if not len(at):
            break
        data[start[at] + k] = values[at] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of the control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    if n and end[-1] != len(data):
        raise ValueError("data bytes do not match the control bytes")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    start = end - size
    out = raw[start].astype(np.uint32)
    at = np.flatnonzero(size > 1)
    for k in (1, 2, 3):
        out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
        at = at[size[at] > k + 1]
        if not len(at):
            break
    return out


def doc_table(docs: list[tuple[int | None, int]]) -> bytes:
    return np.array([(0 if i is None else i, i is not None, n) for i, n in docs], DOC).tobytes()


def write_block(table: bytes, ranks: np.ndarray) -> bytes:
    control, data = pack_ids(ranks)
    return HEAD.pack(MAGIC, len(table) // DOC.itemsize, len(ranks)) + table + control + data


def read_block(image: bytes) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    magic, n_docs, n = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not an id block")
    at = HEAD.size + n_docs * DOC.itemsize
    table = np.frombuffer(image, DOC, n_docs, HEAD.size)
    end = at + -(-n // 4)
    return [(int(x["id"]) if x["known"] else None, int(x["n"])) for x in table], unpack_ids(image[at:end], image[end:], n)


def bounds(ids: DataFrame, n: int) -> tuple[int, list[int]]:
    """(ranges of null ids, ids that cut the others in the other of n ranges of like many rows), from the column of ids alone.

    An id of several ranges' rows is there several times.
    """
    found = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    nulls = round(n * (found["n"] - found["known"]) / found["n"]) if found["n"] else 0
    rest = max(1, n - nulls)
    if rest == 1 or not found["known"]:
        return nulls, []
    return nulls, sorted(ids.agg(F.percentile_approx("doc_id", [k / rest for k in range(1, rest)], 20 * n).alias("x")).first()["x"])


def _place(doc_id: Column, text: Column, nulls: int, cuts: list[int]) -> Column:
    """A row's range: how many of the sorted cuts are below the id, by halving; rows of an id of several ranges go by the text's hash."""
    part = F.shiftrightunsigned(F.xxhash64(text).bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)  # from 0 to 1 in the hash's order
    among = lambda k: F.least(F.floor(part * k).cast("int"), F.lit(k - 1))
    place = F.lit(nulls)
    if cuts:
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
        every = F.lit(cuts).cast("array<bigint>")

        def step(low: Column, by: Column) -> Column:
            return F.when((low + by <= len(cuts)) & (F.try_element_at(every, low + by) < doc_id), low + by).otherwise(low)

        place = F.aggregate(steps, F.lit(0), step) + nulls
        for hot, k in collections.Counter(cuts).items():
            if k > 1:
                place = place + F.when(doc_id == hot, among(k)).otherwise(0)
    return F.when(doc_id.isNull(), among(nulls) if nulls else F.lit(0)).otherwise(place)


def encode_blocks(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents in id order: shard, block, first, n_ids, table, width, ids.

    ids: each text's ids and the end id, unsigned, of ``width`` bytes (2 where all ids fit). Each shard
    ends with a row of block -1, whose ids are its counts of all ids as 64-bit integers.
    """
    names = ["shard", "block", "first", "n_ids", "table", "width", "ids"]
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = byte_pair_ids(path, end_id < 1 << 16, MEMO), TaskContext.get().partitionId()
        width, end = encoder.width, struct.pack(f"<{encoder.code}", end_id)
        block, first, n, docs, parts = 0, 0, 0, [], []
        seen = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

        def close() -> pa.RecordBatch:
            nonlocal block, first, n, docs, parts, seen
            ids = b"".join(parts)
            seen += np.bincount(np.frombuffer(ids, f"<u{width}"), minlength=len(seen))
            out = row(shard, block, first, n, doc_table(docs), width, ids)
            block, first, n, docs, parts = block + 1, first + n, 0, [], []
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                docs.append((doc.as_py(), len(ids) // width))
                parts.append(ids)
                n += len(ids) // width
                if n >= BLOCK:
                    yield close()
        if docs:
            yield close()
        if block:
            yield row(shard, -1, 0, 0, None, 8, seen.tobytes())

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionById(n, _place(F.col("doc_id"), F.col("text"), *bounds(ids, n))).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "shard long, block long, first long, n_ids long, table binary, width int, ids binary")


def id_ranks(encoded: DataFrame) -> DataFrame:
    """(id, n, rank) of every id of the corpus, from the shards' rows of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                total = np.frombuffer(x.as_buffer(), "<i8")
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counts = encoded.filter("block < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row for each id of the vocabulary, so one task suffices at any corpus size
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)


def write_files(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the corpus' ids; returns the written (blocks, ranks).

    blocks: shard, block, first (ids of this shard before the block), n_ids, image. Shards follow
    the order of ids, blocks the order in their shard.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark, "ids")
    encoded = stage.keep(encode_blocks(docs, path, end_id, id_col, text_col), "encoded", packed=False)
    ranks = stage.keep(id_ranks(encoded), "ranks")
    found = np.array([(r["id"], r["rank"]) for r in ranks.select("id", "rank").collect()], np.int64).reshape(-1, 2)  # at most the vocabulary's size
    place = np.zeros(int(found[:, 0].max(initial=-1)) + 1, np.uint32)
    place[found[:, 0]] = found[:, 1]
    shared = spark.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                table, width, ids = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                image = write_block(table, place[np.frombuffer(ids, f"<u{width}")])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(4)), pa.array([image], pa.binary())], names=["shard", "block", "first", "n_ids", "image"])

    blocks = stage.keep(encoded.filter("block >= 0").mapInArrow(run, "shard long, block long, first long, n_ids long, image binary"), "blocks", packed=False)
    stage.drop("encoded")
    return blocks, ranks


def read_files(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written blocks.

    start: the ids of all documents before it. Only one row a shard is summed in a single task.
    """
    spark = blocks.sparkSession
    found = np.array([(r["rank"], r["id"]) for r in ranks.select("rank", "id").collect()], np.int64).reshape(-1, 2)  # at most the vocabulary's size
    ids_of = np.zeros(len(found), "<u4")
    ids_of[found[:, 0]] = found[:, 1]
    shared = spark.sparkContext.broadcast(ids_of)
    names = ["doc_id", "shard", "within", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        for batch in batches:
            for shard, first, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs, ranks = read_block(image.as_py())
                ids = ids_of[ranks].tobytes()
                n = np.array([x[1] for x in docs], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in docs], pa.int64()), pa.array([shard.as_py()] * len(docs), pa.int64()), pa.array(ends - n + first.as_py(), pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=names)

    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])
    decoded = blocks.select("shard", "first", "image").mapInArrow(run, schema)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each shard, so as many as there were partitions
    return decoded.join(F.broadcast(sums.select("shard", F.coalesce("base", F.lit(0)).alias("base"))), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
