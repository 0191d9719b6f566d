"""Encoding with a public tokenizer file, each distinct piece of text once per worker.

Both public BPE layouts cut a text at white space before they merge, so a text's ids are the ids of its pieces in order.
``PieceEncoder`` cuts texts at spaces and line ends, asks the library for each distinct piece, and joins stored ids. The
stored pieces are bounded in number (when there are too many, the half stored last goes); pieces that are long are not stored. Texts in which a cut could change the library's
result (three white spaces in a row, or special strings under the layout that keeps white space) are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

#: The byte-level layouts' letter for each byte, the printable ones as they are and the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b)) for b in range(256)}
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_RUN = re.compile(r"\s\s\s|\s\s\Z")


def _plain(letter: str) -> bool:
    """A letter of which normalising and lower-casing make one letter again."""
    return letter < "\u0250" and letter != "İ" and letter.isalpha()


_PLAIN = [c for c in map(chr, range(0x250)) if _plain(c)]
_LOWER_WORD = re.compile(f"[{''.join(c for c in _PLAIN if c.islower())}]+").fullmatch
_WORD_AND_MARKS = re.compile(f"([{''.join(_PLAIN)}]+)({_MARKS}+)").fullmatch
_WORD_OR_MARKS = re.compile(rf"[^\W\d_]*{_MARKS}*").fullmatch


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceEncoder(dict):
    """ids(text): the library's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 900_000):
        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        pre = layout.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in layout.get("added_tokens", [])]
        self.marked = [t for t in self.special if _WORD_OR_MARKS(t)]  # those that a word and its marks can hold
        first = (pre.get("pretokenizers") or [{}])[0]
        collapses = any(n.get("content") == " " and n.get("pattern", {}).get("Regex") == r"\s+" for n in (layout.get("normalizer") or {}).get("normalizers", []))
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not layout.get("normalizer"):
            self.mode = "kept"
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and collapses:
            self.mode = "dropped"
        self[""] = b""

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        last, ids = piece[-1], None
        if len(piece) > 1 and self.mode == "dropped":
            if _LOWER_WORD(piece):  # a word that normalising and cutting leave as it is
                word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
                ids = _packed([t.id for t in self.model.tokenize(word)])
            elif not last.isalpha() and (parts := _WORD_AND_MARKS(piece)) and not any(t in piece for t in self.marked):
                ids = self[parts[1]] + self[parts[2]]  # letters end before punctuation
            elif "A" <= piece[0] <= "Z":  # the layout lower-cases
                ids = self[piece[0].lower() + piece[1:]]
        elif len(piece) > 2 and self.mode == "kept" and last in ".," and _plain(piece[-2]):
            ids = self[piece[:-1]] + self[last]
        if ids is None:
            ids = self.whole(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > self.most:  # the pieces met first are the common ones: they stay
            while len(self) > self.most // 2:
                self.popitem()
        if self.mode == "dropped":
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if self.mode == "whole" or "\x01" in text or any(s in text for s in self.special) or _RUN.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
