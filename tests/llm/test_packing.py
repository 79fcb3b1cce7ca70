import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

BYTE = P.path("byte_bpe_50k.json")


def verify(rows, docs):
    """rows: (doc, start, length, crc, total, sequence, offset); docs: {doc: ids}."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        ids = docs[doc]
        assert length > 0 and total == len(ids)
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for doc, ids in docs.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
    return lengths


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(4, 64))
def test_packer_pieces(lengths, pool):
    made = []
    packer = packing.TierPacker(lambda tier, pieces: made.append((tier, pieces)), pool=pool)
    docs = {i: list(range(n)) for i, n in enumerate(lengths)}
    for i, ids in docs.items():
        packer.add(i, np.array(ids, "<u4").tobytes())
        assert packer.count <= pool
    packer.finish()
    rows = []
    for k, (tier, pieces) in enumerate(made):
        offset = 0
        for p in pieces:
            rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, k, offset))
            offset += len(p)
        assert offset <= tier
    full = verify(rows, docs)
    assert sum(n not in packing.TIERS for n in full) <= 1


def test_balance():
    steps = packing.balance([9, 1, 8, 2, 7, 3, 6, 4], 4)
    assert sorted(steps) == [0, 0, 1, 1, 2, 2, 3, 3]
    load = defaultdict(int)
    for c, s in zip([9, 1, 8, 2, 7, 3, 6, 4], steps):
        load[s] += c
    assert set(load.values()) == {10}
    assert packing.balance([], 4) == []


def test_query_columns(odd_docs):
    library = Tokenizer.from_file(BYTE)
    docs = odd_docs.dropDuplicates(["doc_id"])
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    got = packing.packed(docs, BYTE).collect()
    lengths = verify([tuple(r)[:7] for r in got], ids)
    parts = len({r.sequence_id >> 36 for r in got})
    assert sum(n not in packing.TIERS for n in lengths) <= parts


def test_ids_kept_and_empty(odd_docs, make_docs):
    row = packing.packed(make_docs([None]), BYTE, keep_ids=True).collect()
    assert len(row) == 1 and bytes(row[0].ids) == b"\0\0\0\0" and row[0].length == 1
    assert packing.packed(odd_docs.limit(0), BYTE).collect() == []


def test_repeated_rows(make_docs):
    docs = make_docs(["same text"], 7).unionByName(make_docs(["same text"], 7))
    assert sum(r.length for r in packing.packed(docs, BYTE).collect()) == 2 * packing.packed(make_docs(["same text"], 7), BYTE).collect()[0].doc_tokens
