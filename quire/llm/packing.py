"""Operator 4: hierarchical multi-length packing.

Documents are cut into pieces and packed into sequences of the context-size tiers ``TIERS``. Whole
1024-id windows of a document are sequences of their own; its rest goes to the smallest tier that
holds it. A tier is packed from its own pieces, the longest first; the gap that a piece leaves in its
window is filled from the shorter tiers, the longest fitting piece first, and where none fits, a
shorter piece is cut to the gap and its rest routed again. So every sequence is exactly as long as
its tier, a power of two, and needs no padding; only the last one of a partition may be shorter.

Sequences of a tier are dealt to training steps in groups of ``STEP``: within a group the costliest
sequence (sum of squared piece lengths, its attention cost) goes to the step with the least cost so
far, so steps of a group have like costs.

Each task packs its own partition in one pass; it holds at most ``POOL`` pieces and one document,
moves no rows between machines, and repeats with the same result if an executor is lost. At most
one sequence a partition is padded, whatever the size of the corpus.

Null or empty texts hold only the end id. Null ids, ties and repeated rows are packed like any row;
each id of each row lies in exactly one piece. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import whole_text
from quire.llm.pretoken import byte_pair_ids

TIERS = (1024, 512, 256, 128, 64)
#: Pieces that wait in the tiers at most, and sequences that are dealt to steps together.
POOL, STEP, STEPS = 1024, 64, 8


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class TierPacker:
    """Packs one partition's documents; ``emit`` gets (tier, pieces) of each finished sequence."""

    def __init__(self, emit: Callable[[int, list[Piece]], None], tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.emit, self.tiers, self.pool = emit, tiers, pool
        self.waiting: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in tiers}
        self.held = dict.fromkeys(tiers, 0)  # ids that wait in each tier
        self.count = self.order = 0

    def add(self, doc, ids: bytes) -> None:
        total, window = len(ids) // 4, self.tiers[0]
        for at in range(0, total - window + 1, window):
            self.emit(window, [Piece(doc, at, ids[4 * at : 4 * (at + window)], total)])
        if rest := total % window:
            self._route(Piece(doc, total - rest, ids[4 * (total - rest) :], total))
            if self.count >= self.pool:
                self._pack(self.pool // 4)

    def _route(self, piece: Piece) -> None:
        tier = next(t for t in reversed(self.tiers) if t >= len(piece))
        self.order += 1
        bisect.insort(self.waiting[tier], (len(piece), self.order, piece))
        self.held[tier] += len(piece)
        self.count += 1

    def _take(self, tier: int, at: int) -> Piece:
        n, _, piece = self.waiting[tier].pop(at)
        self.held[tier] -= n
        self.count -= 1
        return piece

    def _fill(self, gap: int, below: tuple[int, ...]) -> list[Piece]:
        """Pieces from the shorter tiers for a gap; a piece is cut where none fits."""
        out = []
        while gap:
            for tier in below:
                if at := bisect.bisect_right(self.waiting[tier], (gap, self.order + 1)):
                    out.append(self._take(tier, at - 1))
                    gap -= len(out[-1])
                    break
            else:
                tier = next((t for t in reversed(below) if self.waiting[t]), None)
                if tier is None:
                    break
                head, rest = self._take(tier, 0).cut(gap)
                self._route(rest)
                out.append(head)
                gap = 0
        return out

    def _pack(self, keep: int) -> None:
        """Finish sequences, the longest tier first, until ``keep`` pieces wait."""
        for k, tier in enumerate(self.tiers):
            while self.waiting[tier] and self.count > keep:
                if sum(self.held[t] for t in self.tiers[k:]) < tier:
                    break
                first = self._take(tier, len(self.waiting[tier]) - 1)
                # its own tier comes last: a piece of it is cut only if the shorter tiers are empty
                pieces = [first, *self._fill(tier - len(first), (*self.tiers[k + 1 :], tier))]
                self.emit(tier, pieces)

    def finish(self) -> None:
        """Pack all that waits: full sequences of every tier, then at most one that isn't full."""
        self._pack(0)
        left = [self._take(t, len(self.waiting[t]) - 1) for t in self.tiers for _ in range(len(self.waiting[t]))]
        for tier in self.tiers:
            while sum(map(len, left)) >= tier:
                pieces, need = [], tier
                while need:
                    piece = left.pop(0)
                    if len(piece) > need:
                        piece, rest = piece.cut(need)
                        left.insert(0, rest)
                    pieces.append(piece)
                    need -= len(piece)
                self.emit(tier, pieces)
        if left:
            self.emit(self.tiers[0], left)


def balance(costs: list[int], steps: int) -> list[int]:
    """The step of each sequence: costliest first, to the step with least cost and room."""
    room, load = -(-len(costs) // steps), [[0, 0, s] for s in range(steps)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        best = min((x for x in load if x[1] < room))
        best[0] += costs[i]
        best[1] += 1
        out[i] = best[2]
    return out


def packed(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo: int | None = None) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step.

    ``keep_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes; ``memo`` bounds the pre-tokens
    that a worker remembers (memory against speed, not results). sequence_id: partition
    and number within it. step: partition, group of ``STEP`` sequences of one tier, and step in it.
    """
    end = struct.pack("<I", end_id)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        encoder, rows, made = byte_pair_ids(path, memo=memo), [], 0
        open_steps: dict[int, list[tuple[int, list[Piece]]]] = {}
        groups = 0

        def deal(tier: int) -> None:
            nonlocal groups
            group = open_steps.pop(tier)
            for (sequence, pieces), step in zip(group, balance([sum(len(p) ** 2 for p in ps) for _, ps in group], STEPS), strict=True):
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, offset, tier, base + groups * STEPS + step, *[p.ids] * keep_ids))
                    offset += len(p)
            groups += 1

        def emit(tier: int, pieces: list[Piece]) -> None:
            nonlocal made
            open_steps.setdefault(tier, []).append((base + made, pieces))
            made += 1
            if len(open_steps[tier]) >= STEP:
                deal(tier)

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = [kind, *[pa.int64()] * 8, *[pa.binary()] * keep_ids]
                out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows.clear()
                yield out

        packer, kind = TierPacker(emit), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), encoder.encode(text.as_py()) + end)
                if len(rows) >= 4096:
                    yield from flush(kind)
        packer.finish()
        for tier in list(open_steps):
            deal(tier)
        yield from flush(kind)

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:9]) + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema)
