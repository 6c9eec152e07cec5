"""Token ids of whole texts by the ``tokenizers`` library, with a table of the words that were encoded before.

A byte-level BPE never merges across the pieces that its pre-tokenizer cuts. In
a text of single spaces and line ends each space or line end begins a piece, so
the ids of what stands between them don't depend on what is around. Every
distinct word is encoded by the library's model when it is met and remembered. Other
texts (white space in runs, characters above U+02AF, an added token's string)
are given to the library as they are. So are all texts if the tokenizer's file
isn't such a BPE with that very pre-tokenizer and nothing else (``plain``).
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Sequence

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .common import KEPT

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Entries of each half of the tables of words and of pieces in one Python worker (what a dict holds before it grows to the next size but one), and the longest that are kept.
WORDS, PIECES, KEPT_CHARS = 340_000, 170_000, 40
#: The share of them that a lean encoder has.
LEAN = 4
_LAST = 0x2AF


def _ranges(keep) -> str:
    """Characters up to _LAST for whose category keep() holds, as the inside of a character class."""
    out, run = [], None
    for c in range(_LAST + 2):
        if c <= _LAST and keep(unicodedata.category(chr(c))):
            run = (run or (c, c))[0], c
        elif run:
            out.append(f"\\u{run[0]:04x}-\\u{run[1]:04x}")
            run = None
    return "".join(out)


_L, _N = _ranges(lambda k: k[0] == "L"), _ranges(lambda k: k[0] == "N")
_NUMBERS = {chr(c) for c in range(_LAST + 1) if unicodedata.category(chr(c))[0] == "N"}
#: The pre-tokenizer's pieces in a text whose only white space is single spaces and line ends.
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^ \\n{_L}{_N}]+|[ \\n]")
#: Characters outside ASCII to U+02AF, and white space other than the space and the line end.
_ODD = re.compile("[^\\x00-\\u02af]|[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0]")


def _byte_letters() -> dict[int, int]:
    """Of each byte, the character by which byte-level vocabularies name it: itself if visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip(seen, seen)) | dict(zip((b for b in range(256) if b not in seen), range(0x100, 0x200)))


_LETTERS = _byte_letters()
_LETTERS_USED = [chr(c) for c in sorted(_LETTERS.values())]


class _Other(Exception):
    """A text isn't of single spaces, line ends and characters up to _LAST."""


class _Table(dict):
    """A table in two halves: a full one takes the older one's place, and what is asked for again comes back from there. So memory stays bounded and frequent entries stay."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= KEPT_CHARS:
            self[key] = ids
        return ids


class _Pieces(_Table):
    """A piece -> its ids, by the library's BPE model."""

    def __init__(self, model, share: int = 1):
        super().__init__(PIECES // share)
        self.tokenize = model.tokenize
        self.packers: dict[int, struct.Struct] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            letters = f"\u0120{piece[1:]}" if piece[0] == " " and piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_LETTERS)
            ids = [t.id for t in self.tokenize(letters)]
            packer = self.packers.get(len(ids)) or struct.Struct(f"<{len(ids)}I")
            if len(ids) <= KEPT_CHARS:
                self.packers[len(ids)] = packer
            out = packer.pack(*ids)
        return self.keep(piece, out)


class _Words(_Table):
    """What follows a space, up to the next space or line end; or a line end and what follows it -> its ids. _Other where a text of single spaces and line ends has no such word."""

    def __init__(self, pieces: _Pieces, share: int = 1):
        super().__init__(WORDS // share)
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word.isascii() and word.isalpha():
                out = self.pieces[f" {word}"]
            elif word in ("", "\n") or _ODD.search(word):
                raise _Other
            elif word.isalpha():
                out = self.pieces[f" {word}"]
            elif word[:-1].isalpha() and not word[-1].isalnum() and word[-1] not in _NUMBERS:
                out = self.pieces[f" {word[:-1]}"] + self.pieces[word[-1]]
            else:
                out = b"".join(map(self.pieces.__getitem__, _PIECE.findall(word if word[0] == "\n" else f" {word}")))
        return self.keep(word, out)


def plain(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer is a byte-level BPE whose pieces are those of _PIECE: no normalizer, no truncation, nothing that depends on more than a piece."""
    said = json.loads(tokenizer.to_str())
    model, cutter = said["model"], said["pre_tokenizer"] or {}
    return (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex", True)
        and not cutter.get("add_prefix_space")
        and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        and all(t in model["vocab"] for t in _LETTERS_USED)
    )


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers, in bytes; null is an empty text."""

    def __init__(self, path: str | None = None, lean: bool = False):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.tokenizer.encode_special_tokens = False
        self.plain = plain(self.tokenizer)
        share = LEAN if lean else 1
        self.words = _Words(_Pieces(self.tokenizer.model, share), share)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and not any(a in text for a in self.added):
            try:
                # single spaces and line ends, never beside each other or last (that would leave an empty word, or a line end alone): each begins a piece, and all up to the next has ids of its own
                return b"".join(map(self.words.__getitem__, f"\n{text}".replace("\n", " \n")[1:].split(" ")))[4:]
            except _Other:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[tuple[str | None, bool], Encoder] = {}
KEPT["tokens"] = _ENCODERS.clear


def encoder(path: str | None = None, lean: bool = False) -> Encoder:
    """One for each Python worker, path and size of tables."""
    if (path, lean) not in _ENCODERS:
        _ENCODERS[path, lean] = Encoder(path, lean)
    return _ENCODERS[path, lean]


def encode_all(texts: Sequence[str | None], path: str | None = None, end_id: int = END_ID, lean: bool = False) -> list[bytes]:
    """Of each text, its ids and the end id. lean: by smaller tables, the same ids."""
    end = int(end_id).to_bytes(4, "little")
    return [ids + end for ids in map(encoder(path, lean).encode, texts)]
