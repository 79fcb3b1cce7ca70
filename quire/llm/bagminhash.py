"""Operator 6: near-duplicates of word-shingle multisets by BagMinHash.

A document is the multiset of its runs of ``WORDS`` words (lower case, punctuation apart). Two documents
are linked if their weighted Jaccard similarity, sum of least counts over sum of greatest counts, is at
least ``SIMILAR``; the result is the connected components of the links.

Signatures. A shingle's weight axis is cut into the dyadic blocks (0,1], (1,2], (2,4], (4,8], ... Each
block of a shingle carries its own Poisson process of points, with the block's width as rate; a point
has a time, a level inside the block and one of ``SLOTS`` slots, all from hashes of the shingle, the
block and the point's number. A document of weight w sees a block's points whose level is at most w:
all points of the blocks below w, and the thinned points of the block that w lies in. A slot's entry is
the document's earliest point there. Two documents share a slot's entry with a probability equal to
their weighted Jaccard similarity. Points come by rising time, so only those before the time by which
all slots are filled are drawn (``SLOTS`` x (ln SLOTS + 3) points on average whatever the text's
length; the few documents with an empty slot draw again, with doubled time).

Candidates share a band of ``ROWS`` slots; at similarity 0.8 a pair shares none of the bands with a
probability of 3e-6. Equal word sequences are collapsed first and count as one text. Then

1. every text of a bucket is compared with the bucket's leader, the text that meets the most others in
   all its buckets (as the original of a group of copies does), and the links' components are formed: a group of thousands of copies costs one comparison for each copy and band;
2. texts of buckets whose texts are in several components are joined by the elements of their multisets (a shingle and the
   number of its occurrence), by exact bounds only. Elements that no other of these texts has bound the overlap from above, and drop
   most. Of the others an element order, the rarest first, is fixed: two texts of similarity 0.8 share one of the first
   n - ceil(0.8 n) + 1 of n elements, so only those are met, and how many they share and where bounds their overlap; passages that thousands of else unlike texts
   share come last and cost nothing. A pair of texts of unlike components that also shares a bucket is compared.

A pair that is skipped otherwise is one that is already connected, so components lose no candidate
link. Every comparison counts the shingles of whole texts, by 64-bit hashes.

Hot buckets: bucket counts and leaders are aggregated before they are shuffled; the joins that bring
texts together are plain joins, which adaptive execution splits.

Defined results: null text is empty. Texts without words are alike only if they are equal. Texts of
fewer than five words have one shingle, all their words. Null ids form rows of their own: they join
components, and the class id is the smallest id that is not null, or null. Repeated rows share the
class. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Stage, held, whole_text
from quire.llm.components import components
from quire.llm.pretoken import segments

WORDS, SIMILAR = 5, 0.8
SLOTS, ROWS = 96, 4
#: Texts that are read together, and shingles whose points are drawn together.
GROUP, TOGETHER = 64, 1 << 17
_WORD = re.compile(r"\w+")
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values (the splitmix64 finaliser)."""
    x = x + _U(_GOLD)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    """64-bit hashes of words, remembered; starts anew when full."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found



def words_of(text: str) -> np.ndarray:
    """The hashes of a text's words, in order; long texts are read in segments."""
    hashes = held("words", WordHash)
    parts = [np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)) for part in segments(text) if (found := _WORD.findall(part.lower()))]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, rising, and their counts."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(WORDS, n)
    runs = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        runs = mix(runs * _U(_GOLD | 1) + words[k : n - size + 1 + k])
    return np.unique(runs, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if either is empty."""
    (x, n), (y, m) = a, b
    total = int(n.sum() + m.sum())
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x
    common = int(np.minimum(n[same], m[at[same]]).sum())
    return common / (total - common)


def _points(doc: np.ndarray, seed: np.ndarray, cap: np.ndarray, floor: np.ndarray, width: np.ndarray, limit: np.ndarray, n: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, point) of the earliest point in each slot of n documents, of those before each document's limit."""
    first, entry = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    time, k = np.zeros(len(seed)), 0
    end = limit[doc]
    while len(seed):
        k += 1
        h = mix(seed + _U(k * _GOLD & 0xFFFFFFFFFFFFFFFF))
        # 53 bits for the waiting time, never 0
        time = time - np.log(((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / width
        live = np.flatnonzero(time <= end)
        doc, seed, cap, floor, width, end, time, h = (x[live] for x in (doc, seed, cap, floor, width, end, time, h))
        g = mix(h)
        level = floor + np.where(width > 1, np.floor((g >> _U(32)).astype(np.float64) * 2.0**-32 * width), 0) + 1
        place = ((g & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)).astype(np.int64) + doc * slots
        better = np.flatnonzero((level <= cap) & (time < first[place]))
        place, t = place[better], time[better]
        np.minimum.at(first, place, t)
        won = np.flatnonzero(first[place] == t)
        entry[place[won]] = h[better[won]]
    return first, entry


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """For each multiset (not empty) the point that comes first in each slot, as 64-bit hashes."""
    n = len(bags)
    out = np.zeros((n, slots), np.uint64)
    weight = np.array([c.sum() for _, c in bags], np.float64)
    limit = slots / weight * (np.log(slots) + 3)
    doc = np.repeat(np.arange(n), [len(x) for x, _ in bags])
    shingles, counts = (np.concatenate([x[i] for x in bags]) for i in (0, 1))
    # every (shingle, block) whose block begins below the shingle's count: its document, seed, count, floor and width
    rows = [(doc, mix(shingles), counts, np.zeros(len(doc)), np.ones(len(doc)))]
    floor, block, top = 1, 1, int(counts.max(initial=0))
    while floor < top:
        some = np.flatnonzero(counts > floor)
        size = np.full(len(some), float(floor))
        rows.append((doc[some], mix(shingles[some] ^ mix(np.array([block], np.uint64))), counts[some], size, size))
        floor, block = 2 * floor, block + 1
    doc, seed, cap, floors, widths = (np.concatenate(x) for x in zip(*rows, strict=True))
    todo = np.arange(n)
    while len(todo):
        first, entry = _points(doc, seed, cap, floors, widths, limit[todo], len(todo), slots)
        full = np.isfinite(first.reshape(-1, slots)).all(1)
        out[todo[full]] = entry.reshape(-1, slots)[full]
        # the rest once more, with doubled time
        again = np.flatnonzero(~full[doc])
        place = np.cumsum(~full) - 1
        doc, seed, cap, floors, widths = place[doc[again]], seed[again], cap[again], floors[again], widths[again]
        todo = todo[~full]
        limit = limit * 2
    return out


def bands(entries: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of slots, with the band's number in it; a row for each signature."""
    parts = entries.reshape(len(entries), -1, rows)
    out = np.arange(parts.shape[1], dtype=np.uint64)
    for k in range(rows):
        out = mix(out * _U(_GOLD | 1) + parts[:, :, k])
    return out


def text_key(text: str, words: np.ndarray) -> bytes:
    """16 bytes that stand for the word sequence, or for the text if it has no words."""
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"\0" + text.encode("utf-8", "surrogatepass"))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fingerprint, key, n, bands) of every row.

    fingerprint: xxhash64 of the text, to find the row again; n: the multiset's size.
    """
    names = ["doc_id", "fingerprint", "key", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = part.column(2).to_pylist()
                words = list(map(words_of, texts))
                some = np.flatnonzero([len(x) > 0 for x in words])
                n = np.zeros(len(words), np.int64)
                found = np.zeros((0, SLOTS // ROWS), np.int64)
                if len(some):
                    bags = [bag(words[i]) for i in some]
                    n[some] = [c.sum() for _, c in bags]
                    runs = np.cumsum([len(x) for x, _ in bags]) // TOGETHER  # long texts stand alone
                    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1), len(bags)]
                    entries = np.concatenate([signatures(bags[a:b]) for a, b in zip(cuts, cuts[1:])])
                    found = bands(entries).view(np.int64)
                ends = np.cumsum([0, *np.where(n > 0, found.shape[1], 0)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(text_key, texts, words)), pa.binary()), pa.array(n), lists], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("fingerprint"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long, key binary, n long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, stage: Stage, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar, compared exactly."""
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag_a = None, None
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                if (a := batch.column(0)[k].as_py()) != last:
                    last, bag_a = a, bag(words_of(batch.column(2)[k].as_py()))
                keep.append(similarity(bag_a, bag(words_of(batch.column(3)[k].as_py()))) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in batch.columns[:2]], names=["a", "b"])

    # b's text first, then a's: the leader of a large group is a hot key of the second join only
    with_b = stage.keep(pairs.join(right, "b"), f"{name}-b")
    both = with_b.join(left, "a").select("a", "b", "text_a", "text_b")
    found = stage.keep(both.mapInArrow(run, "a long, b long"), f"{name}-links")
    stage.drop(f"{name}-b")
    return found


def _elements(texts: DataFrame) -> DataFrame:
    """(node, element) of the multiset elements of each text: a shingle and the number of its occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shingles, counts = bag(words_of(batch.column(1)[k].as_py()))
                number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                elements = mix(np.repeat(shingles, counts) ^ mix(number.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(elements), batch.column(0)[k].as_py(), np.int64)), pa.array(elements.view(np.int64))], names=["node", "element"])

    return texts.select("node", "text").mapInArrow(run, "node long, element long")


#: Of n elements so many come first that two texts of similarity ``SIMILAR`` share one of them.
_FIRST = f"n - ceil(cast({SIMILAR} as decimal(3,2)) * n) + 1"


def _crossing(members: DataFrame, root: DataFrame, nodes: DataFrame, texts: DataFrame, stage: Stage) -> DataFrame:
    """Pairs (a, b) that share a bucket but no component yet, and can be similar."""
    placed = members.join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = stage.keep(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket"), "mixed")
    some = stage.keep(placed.join(mixed, "bucket").select("node", "root").distinct(), "mixed-nodes")
    # elements of one text only: those leave a text without a partner if they are as many as the first ones
    own = _elements(texts.join(some, "node", "left_semi")).groupBy("element").agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count("*").alias("own"))
    facts = nodes.join(some, "node").join(own, "node", "left").filter(f"coalesce(own, 0) < {_FIRST}")
    facts = stage.keep(facts.select("node", "root", "n", "bands"), "facts")
    elements = stage.keep(_elements(texts.join(facts, "node", "left_semi")), "elements")
    shared = elements.groupBy("element").agg(F.count("*").alias("k")).filter("k > 1")
    shared = stage.keep(elements.join(shared, "element").select("node", "element", "k"), "shared-elements")
    # the first elements of a text are its own ones, then the shared ones by number of texts
    rank = F.row_number().over(Window.partitionBy("node").orderBy("k", "element"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    first = shared.join(facts.select("node", "root", "n"), "node").select("node", "root", "n", "element", rank.alias("rank"), alone.alias("alone"))
    first = stage.keep(first.withColumn("place", F.col("rank") + F.col("alone")).filter(f"place <= {_FIRST}").select("node", "root", "n", "element", "rank", "place"), "first")
    x, y = (first.select("element", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "rank", "place"))) for k in "ab")
    # similar texts share 4/9 of both sizes, one of them so early, and what they share is no more than the shared ones
    # up to any such element and what comes after it
    conditions = [
        "node_a < node_b and root_a <> root_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)",
        "9 * (least(n_a - place_a, n_b - place_b) + 1) >= 4 * (n_a + n_b)",
        "9 * (least(rank_a, rank_b) + least(n_a - place_a, n_b - place_b)) >= 4 * (n_a + n_b)",
    ]
    pairs = x.join(y, [x["element"] == y["element"], *map(F.expr, conditions)])
    pairs = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("c"), *(F.max(k).alias(k) for k in ("n_a", "n_b", "place_a", "place_b")))
    # all that they share are those first ones and what comes after the last of them
    pairs = pairs.filter("9 * (c + least(n_a - place_a, n_b - place_b)) >= 4 * (n_a + n_b)").select("a", "b")
    one, two = (facts.select(F.col("node").alias(k), F.col("bands").alias(f"bands_{k}")) for k in "ab")
    met = stage.keep(pairs, "crossing-all").join(one, "a").join(two, "b").filter("arrays_overlap(bands_a, bands_b)")
    found = stage.keep(met.select("a", "b"), "crossing")
    for name in ("mixed", "elements", "shared-elements", "first", "crossing-all"):
        stage.drop(name)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stage: Stage | None = None) -> DataFrame:
    """(doc_id, fingerprint, root) of every row: rows of one root are copies or near copies."""
    stage = stage or Stage(docs.sparkSession, "bagminhash")
    rows = stage.keep(sketches(docs, id_col, text_col), "rows")
    # one row for each different text; ids are drawn once, the written table fixes them
    nodes = rows.groupBy("key").agg(F.first(F.struct("n", "bands")).alias("x"), F.min(F.struct("doc_id", "fingerprint")).alias("who"))
    nodes = stage.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "x.*", "who"), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    sizes = stage.keep(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    members = stage.keep(members.join(sizes, "bucket"), "shared")  # of buckets with two texts or more
    # a bucket's leader: the text that meets the most others in all its buckets, as a group's original does
    met = stage.keep(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    leads = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", -F.col("node"))).alias("x"))
    leads = stage.keep(leads.select("bucket", (-F.col("x.col2")).alias("a")), "leads")
    members = stage.keep(members.join(leads, "bucket").select("bucket", "a", "node"), "members")
    pairs = stage.keep(members.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    who = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("who.doc_id").alias("__id"), F.col("who.fingerprint").alias("__print"))
    who = stage.keep(who, "who")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("fingerprint"), whole_text(text_col).alias("text"))
    # a text for each candidate: rows of equal id and text are one
    # the same plan at every size: the texts are dealt to the candidates, never the candidates broadcast
    texts = texts.join(who.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__print"))).select("node", "text")
    texts = stage.keep(texts.dropDuplicates(["node"]), "texts")
    links = _verified(pairs, texts, stage, "near")
    root = stage.keep(components(links, stage, "cc1"), "roots1")
    crossing = _crossing(members, root, nodes, texts, stage)
    more = _verified(crossing, texts, stage, "far")
    if not more.isEmpty():
        root = stage.keep(components(links.unionByName(more), stage, "cc2"), "roots2")
    roots = nodes.join(root, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    out = stage.keep(rows.join(stage.keep(roots, "roots"), "key").select("doc_id", "fingerprint", "root"), "classes")
    stage.only("classes")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, class_id (smallest id of its class), n_class (rows of it), kept."""
    stage = Stage(docs.sparkSession, "bagminhash")
    rows = classes(docs, id_col, text_col, stage)
    each = stage.keep(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class")), "each")
    return rows.join(each, "root").select("doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (null last, then by text)."""
    stage = Stage(docs.sparkSession, "bagminhash")
    rows = classes(docs, id_col, text_col, stage)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    # rows of equal id and text in one class: only one of them stays
    many = rows.groupBy("root", "doc_id", "fingerprint").agg(F.count("*").alias("__n"))
    best = best.select("root", F.col("best.doc_id").alias("doc_id"), F.col("best.fingerprint").alias("fingerprint"))
    keep = best.alias("x").join(many.alias("y"), F.expr("x.root = y.root and x.doc_id <=> y.doc_id and x.fingerprint = y.fingerprint")).select(F.col("x.doc_id").alias("__id"), F.col("x.fingerprint").alias("__print"), "__n")
    keep = stage.keep(keep, "keep")
    text = whole_text(text_col)
    kept = docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print")))
    once = kept.filter("__n = 1").select(*docs.columns)
    again = kept.filter("__n > 1").dropDuplicates(["__id", "__print"]).select(*docs.columns)
    return once.unionByName(again)
