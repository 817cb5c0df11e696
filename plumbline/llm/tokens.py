"""Encoding by a public byte-level BPE tokenizer's file inside tasks.

Words repeat, so the library encodes each word once and its ids are kept. That is exact where text is cut only at places
where the tokenizer's own pattern begins a new word, since no merge crosses words:

* before a space that a non-space character follows (a piece);
* within a piece of plain characters (tab, line ends, ASCII and Latin-1 letters), at each match of that pattern (``_WORD``,
  written out for those characters); such a word goes straight to the library's model, in the model's alphabet of bytes.

Pieces with other characters, and texts with a special token's string, are not cut further; the whole tokenizer encodes them. So
it does with all texts where the tokenizer's file asks for anything but that pattern over a plain byte-level model.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import END_ID, TOKENIZER

#: Words and pieces whose ids a process keeps in each of two generations: once the new one is full it becomes the old one, and
#: what is met again moves from the old one to the new.
KEPT_WORDS = 100_000
KEPT_PIECES = 160_000
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_L}]*")
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_CUT = re.compile(r" (?=\S)")


def _alphabet() -> dict[int, int]:
    """A byte-level model's letter for each byte. Printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class _Kept(dict):
    def __init__(self, most: int, make):
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer file's words are those of ``_WORD``: byte-level with its own pattern, nothing before or after it, no token
    added but of the form <|...|>, and a model whose merges are all that acts within a word."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return (
        before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not before.get("add_prefix_space")
        and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        and all("<|" in t["content"] and not t.get("lstrip") and not t.get("rstrip") for t in spec.get("added_tokens") or [])
        and model.get("type") == "BPE" and not any(model.get(k) for k in plain)
    )


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, the end id last."""

    def __init__(self, name: str = TOKENIZER, end_id: int = END_ID):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.cuts = cuttable(json.loads(self.tokenizer.to_str()))
        self.end = array("I", [end_id]).tobytes()
        self.model, self.alphabet = self.tokenizer.model, _alphabet()
        self.words = _Kept(KEPT_WORDS, self._word)
        #: Keys lack the space that stands before a piece.
        self.pieces = _Kept(KEPT_PIECES, self._piece)

    def forget(self) -> None:
        """Drops the ids kept so far."""
        for kept in (self.words, self.pieces):
            kept.clear()
            kept.old = {}

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece of one word, as most are, is kept once, as a piece."""
        found = _WORD.findall(" " + piece)
        return self._word(found[0]) if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(text)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """A null text counts as an empty one: the end id alone."""
        if not text:
            return self.end
        if not self.cuts or "<|" in text:
            return self._whole(text) + self.end
        if not _PLAIN.fullmatch(text):
            first, *rest = _CUT.split(text)
            parts = [first, *[" " + x for x in rest]]
            return b"".join([self._plain(x) if _PLAIN.fullmatch(x) else self._whole(x) for x in parts]) + self.end
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[0] == " " or text[-1] == " ":
            return self._plain(text) + self.end
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.pieces.__getitem__, rest)) + self.end


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str = TOKENIZER, end_id: int = END_ID) -> Encoder:
    """The process's own, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (name, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(name, end_id)
    return _encoders[key]
