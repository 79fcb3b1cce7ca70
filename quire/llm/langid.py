"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (the lower-cased pieces of
letters of a sentencepiece file; a word's first piece begins with the word mark). A word's probability is
the sum over all its segmentations into pieces of the product of their probabilities, which the forward
algorithm sums in one pass over the word; a text's is the product over its words. The prediction is
the language of the greatest posterior probability, which is the score; priors are the shares of
learnt documents.

Learning. Words are counted by language over all documents to learn from, by partition first; then
expectation-maximisation refines the piece probabilities: each round the forward and backward sums
of every distinct word give the expected number of uses of every piece. A round returns at most
(vocabulary x languages) rows to the driver, whatever the corpus' size; the word table stays
distributed.

Forward sums run over many distinct words at once: substrings are looked up by rolling hashes in a
table of piece hashes. A worker remembers the words it has scored, up to ``MEMO``. Runs of more than ``LONG`` letters, as in scripts
without spaces, are summed one by one in logarithms along the run, so they are neither cut nor remembered.

Defined results: null text, or a text without a letter, is ``und`` with score 0; so is every text if
nothing was learnt. Ties go to the first language by name. Letters outside the vocabulary have a
small probability, the same in all languages. Rows
without language are not learnt from. Only the text is an input of a prediction.
"""

from __future__ import annotations

import collections
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stage, doc_crc, whole_text
from quire.llm.pretoken import segments

LONG, ROUNDS, SMOOTH, FLOOR = 24, 2, 0.1, 1e-6
MEMO = 400_000
#: Words whose sums run together.
TOGETHER = 20_000
UNKNOWN = "und"
MARK = "▁"
#: More languages than this are refused: their piece table would not be small.
LANGUAGES = 1000
_WORD = re.compile(r"[^\W\d_]+")
_U = np.uint64
_BASE, _GOLD = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    out: list[str] = []
    for part in segments(text):
        out += _WORD.findall(part.lower())
    return out


class Pieces:
    """The vocabulary: pieces of letters, and their ids by rolling hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        self.names = sorted(x for x in names if re.fullmatch(f"{MARK}?[^\\W\\d_]+", x) or x == MARK)
        self.longest = max(map(len, self.names))
        self.size = len(self.names)
        self.power = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.bits = max(8, int(self.size * 4).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        for i, name in enumerate(self.names):
            h = 0
            for c in name:
                h = (h * _BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
            at = (h * _GOLD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.ids[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; ``size`` where there is no such piece."""
        at = ((h * _U(_GOLD)) >> _U(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), self.size, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            slot = at[todo]
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == h[todo])
            out[todo[hit]] = ids[hit]
            todo = todo[(ids >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """(order, lengths, edges): words by falling length; edges (from, to, piece of the words that reach to)."""
        length = np.array([len(x) + 1 for x in words])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        longest = int(length[0])
        text = "".join((MARK + words[i]).ljust(longest, "\0") for i in order)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), longest).astype(np.uint64)
        prefix = np.zeros((longest + 1, len(words)), np.uint64)
        for i in range(longest):
            prefix[i + 1] = prefix[i] * _U(_BASE) + codes[:, i]
        edges = []
        for to in range(1, longest + 1):
            n = int(np.searchsorted(-length, -to, side="right"))
            for start in range(max(0, to - self.longest), to):
                edges.append((start, to, self.find(prefix[to, :n] - prefix[start, :n] * self.power[to - start])))
        return order, length, edges


    def along(self, word: str) -> np.ndarray:
        """Piece ids (end, length - 1) of all substrings of a marked word; ``size`` where there is no such piece."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        out, h = np.full((len(codes) + 1, self.longest), self.size, np.int64), np.zeros(len(codes) + 1, np.uint64)
        for n in range(1, min(self.longest, len(codes)) + 1):
            h = h[:-1] * _U(_BASE) + codes[n - 1 :]
            out[n:, n - 1] = self.find(h)
        return out


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _forward(edges: list, length: np.ndarray, weight) -> np.ndarray:
    """Forward sums (position, word, language); ``weight(from, to, pieces)`` gives an edge's probabilities."""
    shape = weight(*edges[0]).shape
    alpha = np.zeros((int(length[0]) + 1, len(length), shape[1]))
    alpha[0] = 1
    for start, to, found in edges:
        n = len(found)
        alpha[to, :n] += alpha[start, :n] * weight(start, to, found)
    return alpha


def _logs(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log probability (end, length - 1, language) of a run's substrings."""
    out = table[found]
    out[1:, 0] = np.maximum(out[1:, 0], FLOOR)
    with np.errstate(divide="ignore"):
        return np.log(out)


def _sums(logs: np.ndarray) -> np.ndarray:
    """Forward sums (position, language) along a run, in logarithms."""
    n, longest = len(logs) - 1, logs.shape[1]
    out = np.full((n + 1 + longest, logs.shape[2]), -np.inf)  # what lies before the run has no probability
    out[longest] = 0
    for to in range(1, n + 1):
        x = out[longest + to - 1 : to - 1 : -1] + logs[to]
        top = x.max(0)
        out[longest + to] = top + np.log(np.exp(x - top).sum(0))
    return out[longest:]


def word_scores(vocabulary: Pieces, words: list[str], table: np.ndarray) -> np.ndarray:
    """log probability of each word in each language; table: (pieces + 1, languages)."""
    out = np.zeros((len(words), table.shape[1]))
    for i in [i for i, x in enumerate(words) if len(x) > LONG]:
        out[i] = _sums(_logs(vocabulary.along(words[i]), table))[-1]
    short = np.array([i for i, x in enumerate(words) if len(x) <= LONG], np.int64)
    for k in range(0, len(short), TOGETHER):
        place = short[k : k + TOGETHER]
        some = [words[i] for i in place]
        order, length, edges = vocabulary.lattice(some)
        alpha = _forward(edges, length, lambda start, to, found: np.maximum(table[found], FLOOR) if to - start == 1 else table[found])
        out[place[order]] = np.log(alpha[length, np.arange(len(some))])
    return out


def _uses_along(vocabulary: Pieces, word: str, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected uses) in a run of one language; table: (pieces + 1,); without it, all matches count alike."""
    found = vocabulary.along(word)
    if table is None:
        return found[1:].reshape(-1), np.ones(found[1:].size)
    logs = _logs(found, table[:, None])
    ahead = _sums(logs)[:, 0]
    # backward sums are forward sums of the run read from its end: length n that ends at e begins at e - n
    n, longest = len(found) - 1, logs.shape[1]
    turned = np.full_like(logs, -np.inf)
    for k in range(min(longest, n)):
        turned[k + 1 :, k] = logs[k + 1 :, k][::-1]
    back = _sums(turned)[::-1, 0]
    start = np.arange(n + 1)[:, None] - np.arange(1, longest + 1)
    with np.errstate(invalid="ignore"):
        uses = np.exp(np.where(start >= 0, ahead[np.maximum(start, 0)], -np.inf) + logs[:, :, 0] + back[:, None] - ahead[-1])
    return found[1:].reshape(-1), uses[1:].reshape(-1)


def expected_uses(vocabulary: Pieces, words: list[str], counts: np.ndarray, language: np.ndarray, table: np.ndarray | None, languages: int) -> np.ndarray:
    """Expected uses (pieces + 1, languages) of each piece; without a table, all matches count alike."""
    uses = np.zeros((vocabulary.size + 1) * languages)
    for i in [i for i, x in enumerate(words) if len(x) > LONG]:
        found, n = _uses_along(vocabulary, words[i], None if table is None else table[:, language[i]])
        uses += np.bincount(found * languages + language[i], n * float(counts[i]), len(uses))
    short = np.array([i for i, x in enumerate(words) if len(x) <= LONG], np.int64)
    for k in range(0, len(short), TOGETHER):
        place = short[k : k + TOGETHER]
        some = [words[i] for i in place]
        order, length, edges = vocabulary.lattice(some)
        c, lang = counts[place][order].astype(float), language[place][order]
        if table is None:
            for _, _, found in edges:
                uses += np.bincount(found * languages + lang[: len(found)], c[: len(found)], len(uses))
            continue

        def weight(start: int, to: int, found: np.ndarray, lang: np.ndarray = lang) -> np.ndarray:
            x = table[found, lang[: len(found)]][:, None]
            return np.maximum(x, FLOOR) if to - start == 1 else x

        alpha = _forward(edges, length, weight)[:, :, 0]
        beta = np.zeros_like(alpha)
        rows = np.arange(len(some))
        beta[length, rows] = 1
        scale = c / alpha[length, rows]
        for start, to, found in reversed(edges):
            n = len(found)
            flow = weight(start, to, found)[:, 0] * beta[to, :n]
            beta[start, :n] += flow
            uses += np.bincount(found * languages + lang[:n], alpha[start, :n] * flow * scale[:n], len(uses))
    return uses.reshape(-1, languages)


class Model:
    """languages, log priors, and the table of piece probabilities (pieces + 1, languages)."""

    def __init__(self, path: str, languages: list[str], priors: np.ndarray, table: np.ndarray):
        self.path, self.languages, self.priors, self.table = path, languages, priors, table
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def _learn(self, words: set[str]) -> None:
        if new := list(words.difference(self.memo)):
            if len(self.memo) + len(new) > MEMO:
                self.memo, self.rows, new = {}, self.rows[:0], list(words)
            self.memo.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, word_scores(pieces_of(self.path), new, self.table)])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [words_of(x) for x in texts]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        every = set().union(*split)
        long_ones = {x for x in every if len(x) > LONG}
        self._learn(every - long_ones)
        for i, words in enumerate(split):
            if any(map(str.isalpha, "".join(words))):
                long = [x for x in words if x in long_ones] if long_ones else []
                words = [x for x in words if x not in long_ones] if long else words
                total = self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].sum(0) + self.priors
                if long:
                    total = total + word_scores(pieces_of(self.path), long, self.table).sum(0)
                best = int(total.argmax())
                out[i] = (self.languages[best], float(1 / np.exp(total - total[best]).sum()))
        return out


def fit(docs: DataFrame, path: str, lang_col: str = "lang", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Learn from all rows of ``docs`` whose language is not null."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "langid")
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, collections.Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = seen.setdefault(lang.as_py(), collections.Counter())
                found.update(words_of(text.as_py()))
                found[""] += 1  # documents
            if sum(map(len, seen.values())) > MEMO:
                yield from flush()
        yield from flush()

    counted = stage.keep(known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    found = counted.filter("word = ''").select("lang", "n").limit(LANGUAGES + 1).collect()  # one row for each language
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in found]
    priors = np.log(np.array([r["n"] for r in found], float) / max(1, sum(r["n"] for r in found)))
    vocabulary = pieces_of(path)
    if not languages:
        return Model(path, [], priors, np.zeros((vocabulary.size + 1, 0)))
    place = {x: i for i, x in enumerate(languages)}
    table = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast((table, place))

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, place = shared.value
            vocabulary, total = pieces_of(path), None
            for batch in batches:
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                got = expected_uses(vocabulary, words, n, np.array([place[x] for x in batch.column(0).to_pylist()], np.int64), table, len(place))
                total = got if total is None else total + got
            if total is not None:
                piece, lang = np.nonzero(total[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang], pa.float64())], names=["piece", "lang", "n"])

        got = counted.filter("word <> ''").mapInArrow(uses, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()  # at most vocabulary x languages
        table = np.full((vocabulary.size + 1, len(languages)), SMOOTH)
        for r in got:
            table[r["piece"], r["lang"]] += r["n"]
        table[-1] = 0
        table /= table.sum(0)
    return Model(path, languages, priors, table)


def predicted(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                got = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=names)

    rows = docs.select(*keep, whole_text(text_col).alias("__whole"))
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def predictions(docs: DataFrame, path: str, learn: Column | None = None, folds: int = 3, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """id, held_out (crc32 of the id mod ``folds`` is 1; never learnt from), lang_pred, score."""
    rest = doc_crc(id_col) % folds
    model = fit(docs.filter(rest != 1 if learn is None else learn), path, lang_col)
    return predicted(docs, model, [id_col]).select(id_col, (rest == 1).alias("held_out"), "lang_pred", "score")
