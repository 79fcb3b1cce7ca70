"""Exact pre-token splitting for public tokenizer files, with per-piece memos.

A tokenizer of these files first normalises a text, then splits it into pre-tokens, then merges
inside each pre-token alone. So the ids of a text are the ids of its pre-tokens, joined. A memo
over pre-tokens gives the library's ids for repeated pre-tokens without running its merges again.

Runs in which every character is in ``SAFE`` are split here by a compiled pattern; there, the
classes of letters, digits and white space are spelled out character by character, so they can't
differ from the library's (tests compare all of them). Runs with other characters, between single spaces that begin a
pre-token whatever else is around, go to the library; so does any text with one of the tokenizer's special strings, whole.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

from quire.llm.common import held

#: Code points below this are split here, other texts by the library.
SAFE = 0x300
#: Pre-tokens a memo holds, in two halves: the newer, and the older that is dropped when the newer
#: is full. About 200 bytes each, so some 200 MB a worker; callers with less memory pass a smaller one.
MEMO = 1_000_000
#: Texts are split in segments of about so many characters, cut where no pre-token spans the cut.
SEGMENT = 1 << 20

_UNSAFE = re.compile(f"[^\\x00-{chr(SAFE - 1)}]")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0]) (?=[^\s\x1c-\x1f\x85\xa0])")


def _class(categories: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SAFE) if unicodedata.category(chr(c))[0] in categories)


_L, _N, _S = _class("L"), _class("N"), "\t\n\x0b\x0c\r \x85\xa0"
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: fixed values: the pre-token patterns of the two tokenizer files
BYTE_LEVEL = re.compile(f"{_SUFFIX}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_LEVEL = re.compile(f"{_SUFFIX}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def is_safe(text: str) -> bool:
    return text.isascii() or not _UNSAFE.search(text)


def segments(text: str, size: int | None = None) -> Iterator[str]:
    """Pieces of the text; each cut lies before a single space between two other characters.

    Such a space starts a new pre-token in either pattern. Where there is none, a piece is longer.
    """
    at, size = 0, size or SEGMENT
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_AT = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0])(?= [^\s\x1c-\x1f\x85\xa0])")


def runs(text: str) -> Iterator[tuple[bool, str]]:
    """(safe, part) of a text, joined as far as they are alike; cut before single spaces between two other characters."""
    if is_safe(text):
        yield True, text
        return
    for safe, parts in itertools.groupby(_AT.split(text), is_safe):
        yield safe, "".join(parts)


def load(path: str):
    """The tokenizers library's tokenizer of a file, single-threaded (Spark gives one core a task)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class PieceIds(dict):
    """The ids of pre-tokens as little-endian unsigned bytes of a width, by the library's merges.

    Two halves: this one, and the older one that is dropped when this one is full, so pieces that
    come again and again stay.
    """

    def __init__(self, tokenizer, code: str, memo: int):
        super().__init__()
        self.code, self.half = code, max(1, memo // 2)
        self.merges = tokenizer.model.tokenize
        self.letters = {b: ord(c) for b, c in byte_alphabet().items()}
        self.blank = chr(self.letters[0x20])
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            if piece.isascii() and piece.lstrip(" ").isalpha():
                got = self.merges(piece.replace(" ", self.blank))  # other letters stand for themselves
            else:
                got = self.merges(piece.encode().decode("latin-1").translate(self.letters))
            found = struct.pack(f"<{len(got)}{self.code}", *(x.id for x in got))
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class BytePairIds:
    """Ids of whole texts for a byte-level tokenizer file, as little-endian unsigned bytes.

    Four bytes an id; with ``narrow`` two, where all ids fit.
    """

    def __init__(self, path: str, narrow: bool = False, memo: int | None = None):
        self.tokenizer = load(path)
        self.code = "H" if narrow and self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = struct.calcsize(f"<{self.code}")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceIds(self.tokenizer, self.code, MEMO if memo is None else memo)

    def _by_library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._by_library(text)
        if not is_safe(text):
            return b"".join(self.encode(part) if safe else self._by_library(part) for safe, part in runs(text))
        get = self.pieces.__getitem__
        if len(text) <= SEGMENT:
            return b"".join(map(get, BYTE_LEVEL.findall(text)))
        return b"".join(b"".join(map(get, BYTE_LEVEL.findall(part))) for part in segments(text))


def byte_pair_ids(path: str, narrow: bool = False, memo: int | None = None) -> BytePairIds:
    """One encoder a Python worker: its memo serves all tasks of a stage that the worker runs."""
    return held(("ids", path, narrow, memo), lambda: BytePairIds(path, narrow, memo))
