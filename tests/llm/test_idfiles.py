import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import idfiles

BYTE = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_coding_round_trip(values):
    control, data = idfiles.pack_ids(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert idfiles.unpack_ids(control, data, len(values)).tolist() == values


def test_block_round_trip_and_damage():
    docs = [(None, 2), (-5, 0), (2**40, 3)]
    image = idfiles.write_block(idfiles.doc_table(docs), np.array([1, 256, 65536, 2**24, 0], np.uint32))
    got, values = idfiles.read_block(image)
    assert got == docs and values.tolist() == [1, 256, 65536, 2**24, 0]
    with pytest.raises(ValueError):
        idfiles.read_block(image[:-1])
    with pytest.raises(ValueError):
        idfiles.read_block(b"XXXX" + image[4:])


def brute(docs):
    library, start, out = Tokenizer.from_file(BYTE), 0, []
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_equal_brute_force(odd_docs, monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK", 50)
    blocks, ranks = idfiles.write_files(odd_docs, BYTE)
    got = sorted(map(tuple, idfiles.read_files(blocks, ranks).collect()), key=lambda r: r[1])
    want = brute(odd_docs)
    assert [r[0] for r in got] == [r[0] for r in want]
    # rows of one id may stand in any order among themselves
    assert sorted((r[0], *r[2:]) for r in got if r[0] is not None) == sorted((r[0], *r[2:]) for r in want if r[0] is not None)
    assert sum(r[2] for r in got) == sum(r[2] for r in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    order = ranks.orderBy("rank").collect()
    assert [r["n"] for r in order] == sorted((r["n"] for r in order), reverse=True)


def test_empty_table(odd_docs):
    blocks, ranks = idfiles.write_files(odd_docs.limit(0), BYTE)
    assert idfiles.read_files(blocks, ranks).collect() == []


def test_ranges(spark):
    ids = spark.range(1000).select((F.col("id") * 7 % 1000 - 300).alias("doc_id"), F.col("id").cast("string").alias("text")).unionByName(spark.sql("SELECT cast(null AS bigint) doc_id, 'x' text"))
    nulls, cuts = idfiles.bounds(ids, 7)
    rows = ids.select("doc_id", idfiles._place(F.col("doc_id"), F.col("text"), nulls, cuts).alias("p")).collect()
    assert nulls == 0 and all(r.p == (0 if r.doc_id is None else sum(c < r.doc_id for c in cuts)) for r in rows)
    sizes = [sum(r.p == k for r in rows) for k in range(7)]
    assert max(sizes) < 1.3 * min(sizes)
    assert idfiles.bounds(ids.limit(0), 7) == (0, []) and idfiles.bounds(ids, 1) == (0, [])


def test_hot_ids_and_null_ids_are_split(spark):
    doc_id = F.when(F.col("id") % 3 == 0, F.lit(500)).when(F.col("id") % 3 == 1, F.col("id"))  # a third of one id, a third null
    rows = spark.range(3000).select(doc_id.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    nulls, cuts = idfiles.bounds(rows, 12)
    placed = rows.select("doc_id", F.xxhash64("text").alias("h"), idfiles._place(F.col("doc_id"), F.col("text"), nulls, cuts).alias("p")).collect()
    sizes = [sum(r.p == k for r in placed) for k in range(12)]
    assert nulls == 4 and sum(sizes) == 3000 and max(sizes) < 2 * 250
    order = [(r.p, r.doc_id is not None, r.doc_id or 0, r.h) for r in placed]
    assert sorted(order) == sorted(order, key=lambda r: r[1:])  # ranges follow the order of ids and hashes


def test_hot_ids_equal_brute_force(spark):
    docs = spark.createDataFrame([(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * (i % 4)) for i in range(90)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "block", "first", "ids", "rank", "n")})
    blocks, ranks = idfiles.write_files(docs, BYTE)
    got = sorted(map(tuple, idfiles.read_files(blocks, ranks).collect()), key=lambda r: r[1])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(((r[0], 0, *r[2:]) for r in got), key=key) == sorted(((r[0], 0, *r[2:]) for r in brute(docs)), key=key)
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert [r[0] for r in got] == [r[0] for r in brute(docs)]
