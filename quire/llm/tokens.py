"""Operator 1: token counts by the whole-token shortcut.

Before the job starts, ``prove`` encodes every string of the vocabulary alone and keeps those that
are one pre-token and come back as one token: the proven whole tokens. In a text, a pre-token that
is in the proven set counts one; only the rest goes through the library's merges, each distinct
one once (a bounded memo). The proof is broadcast; its size is bounded by the vocabulary file.

Nulls and empty texts count no tokens. Repeated rows give repeated rows. Every other column of the
input is ignored, so extra or clashing columns are harmless.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import pretoken
from quire.llm.common import whole_text

LIMIT = 2048


def _kind(tokenizer) -> tuple[str, str]:
    """('word' or 'byte', the suffix that marks a word's end)."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    return ("word" if suffix else "byte"), suffix


@functools.cache
def prove(path: str) -> frozenset[str]:
    """The pre-tokens (normalised strings) that the file's tokenizer encodes alone as one token."""
    tokenizer = pretoken.load(path)
    kind, suffix = _kind(tokenizer)
    pattern = pretoken.WORD_LEVEL if kind == "word" else pretoken.BYTE_LEVEL
    back, strings = {c: b for b, c in pretoken.byte_alphabet().items()}, []
    for entry in tokenizer.get_vocab():
        if suffix and not entry.endswith(suffix):
            continue
        body = entry[: len(entry) - len(suffix)] if suffix else entry
        try:
            text = bytes(back[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and pretoken.is_safe(text) and pattern.fullmatch(text) and pattern.findall(text) == [text] and (kind == "byte" or text == text.lower()):
            strings.append(text)
    got = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(text for text, x in zip(strings, got, strict=True) if len(x.ids) == 1)


class Counter:
    """Counts the tokens of whole texts for one tokenizers file."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = pretoken.load(path)
        self.kind, _ = _kind(self.tokenizer)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = pretoken.WORD_LEVEL if self.kind == "word" else pretoken.BYTE_LEVEL
        self.whole, self.merged = whole, {}
        self.shortcut = 0  # pre-tokens that took it in the last text

    def _merge(self, pieces: set[str]) -> None:
        if new := list(pieces.difference(self.merged)):
            if len(self.merged) + len(new) > pretoken.MEMO:
                self.merged, new = {}, list(pieces)
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.merged.update((piece, len(x.ids)) for piece, x in zip(new, got, strict=True))

    def count(self, text: str) -> int:
        self.shortcut = 0
        if any(x in text for x in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, whole = 0, self.whole
        for safe, run in pretoken.runs(text):
            if not safe:
                total += len(self.tokenizer.encode(run, add_special_tokens=False).ids)
                continue
            for part in pretoken.segments(run):
                pieces = self.pattern.findall(part.lower() if self.kind == "word" else part)
                rest = [x for x in pieces if x not in whole]
                self.shortcut += len(pieces) - len(rest)
                if rest:
                    self._merge(set(rest))
                    total += sum(map(self.merged.__getitem__, rest))
        return total + self.shortcut


class PieceCounter:
    """sentencepiece files: its pieces may span spaces, so no whole-token proof holds; whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    shortcut = 0

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1)) if text else 0


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), n_shortcut of every whole text.

    n_shortcut: the tokens counted by the whole-token shortcut.

    ``path``: a tokenizers ``.json`` or a sentencepiece ``.model`` file, present on every machine.
    Null text counts as empty (0 bytes, 0 tokens); a null id stays null.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove(path)) if path.endswith(".json") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value) if whole else PieceCounter(path)
        for batch in batches:
            got = [(counter.count(x.as_py()), counter.shortcut) for x in batch.column(1)]
            n, short = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(short, pa.int64())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_shortcut"])

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__text")).withColumn("__bytes", F.octet_length("__text").cast("long"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_shortcut long")
