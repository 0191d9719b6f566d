"""BPE as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Encoding. A token sequence is the BPE encoding of a string exactly when each neighbouring pair of its tokens is stable,
that is, encodes to itself. So every prefix of a string has one last token, found among the vocabulary's tokens that end
there: the longest whose predecessor (the last token of the prefix before it) forms a stable pair with it. ``Transducer``
keeps these last tokens for the newest positions only. Whatever follows, an encoding must pass through one of the last
``width`` positions (the longest token's length); tokens before the positions' common ancestor are therefore final and
are emitted at once. ``lookahead`` bounds how far back an unstable token can lie: a boundary is undone only by a chain of
merge rules of falling rank, each touching the right edge of the one before, so the longest such chain in the merge list
times the longest token suffices. Memory is constant in the length of the text.

Decoding. ``Decoder`` takes ids in any portions. ``joined`` gives the public library's text for a file without a decoder
(token strings with single spaces between them); ``text`` turns the byte alphabet back to bytes, word ends to spaces, and
emits characters as soon as their UTF-8 bytes are complete.

Cases: null and empty texts have no ids and decode to the empty text; very long words stream through; repeated rows give
equal results; empty tables give empty results; other columns are ignored; special strings inside texts are their own ids,
as the library has them by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ready

END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible in Latin-1, else 256 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Rules:
    """A word-end BPE's vocabulary and merges over symbols: one character per byte, shifted by 1024 for a word's last."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        model = layout["model"]
        self.names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in layout["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in layout["added_tokens"]}
        split = next(p for p in layout["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.symbols = {self.spell(t): i for t, i in model["vocab"].items()}
        self.width = max(map(len, self.symbols))
        self.rank = {(self.spell(a), self.spell(b)): r for r, (a, b) in enumerate(model["merges"])}
        self.byte = [chr(0x4000 + b) for b in range(256)]
        self.stable: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, str]] = {a + b: (a, b) for a, b in self.rank}

    def spell(self, token: str, own: dict = {c: chr(0x4000 + b) for b, c in enumerate(byte_alphabet())}) -> str:  # noqa: B006
        last = token.endswith(END)
        out = "".join(own[c] for c in (token[: -len(END)] if last else token))
        return out[:-1] + chr(ord(out[-1]) + 1024) if last and out else out

    def lookahead(self) -> int:
        """Symbols after which a token is final, whatever follows: the longest falling chain of rules times the width."""
        longest, by_left = 1, {}
        for a, b in self.rank:  # in the order of their ranks
            chain, edge = 1, b
            while True:
                chain = max(chain, 1 + by_left.get(edge, 0))
                if edge not in self.parts:
                    break
                edge = self.parts[edge][1]
            by_left[a] = max(by_left.get(a, 0), chain)
            longest = max(longest, chain)
        return longest * self.width

    def merge(self, symbols: str) -> list[str]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until no rule fits."""
        out = list(symbols)
        while len(out) > 1:
            rank, at = min((self.rank.get(pair, 1 << 30), i) for i, pair in enumerate(zip(out, out[1:])))
            if rank == 1 << 30:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def fits(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) > 400_000:
                self.stable.clear()
            known = self.stable[left, right] = self.merge(left + right) == [left, right]
        return known


class Transducer:
    """push(symbols) and finish() give the ids that have become final; one word at a time."""

    def __init__(self, rules: Rules):
        self.rules, self.bound = rules, rules.width
        self.reset()

    def reset(self) -> None:
        self.tail, self.nodes = "", [(None, "")]  # nodes[i]: (node before the last token, last token) i symbols into tail

    def push(self, symbols: str) -> list[int]:
        out = []
        for at in range(0, len(symbols), 4 * self.bound):
            self.tail += symbols[at : at + 4 * self.bound]
            self._extend()
            if len(self.tail) > 4 * self.bound:
                out += self._settle()
        return out

    def _extend(self) -> None:
        """The last tokens of the prefixes that the new symbols end."""
        tail, nodes, known, fits, width = self.tail, self.nodes, self.rules.symbols, self.rules.fits, self.bound
        for end in range(len(nodes), len(tail) + 1):
            node = None
            for start in range(max(0, end - width), end):
                token = tail[start:end]
                if token in known and (before := nodes[start]) and (not before[1] or fits(before[1], token)):
                    node = (before, token)
                    break
            nodes.append(node)

    def _settle(self) -> list[int]:
        """Emits what all live positions share and forgets it."""
        chains = []
        for node in self.nodes[-self.bound :]:
            chain = []
            while node and node[0] is not None:
                chain.append(node)
                node = node[0]
            if chain:
                chains.append(chain[::-1])
        shared = 0
        for same in zip(*chains):
            if any(n is not same[0] for n in same):
                break
            shared += 1
        if shared < 2:
            return []
        done = [n[1] for n in chains[0][: shared - 1]]
        self.tail, self.nodes = self.tail[sum(map(len, done)) :], [(None, done[-1])]
        self._extend()
        return [self.rules.symbols[t] for t in done]

    def finish(self) -> list[int]:
        out, node = [], self.nodes[len(self.tail)]
        while node and node[0] is not None:
            out.append(self.rules.symbols[node[1]])
            node = node[0]
        self.reset()
        return out[::-1]


class Encoder(dict):
    """ids(text) by the transducer; the ids of short pieces between spaces are kept, a bounded number of them."""

    def __init__(self, path: str, most: int = 700_000):
        super().__init__()
        self.rules, self.most = Rules(path), most
        self.machine = Transducer(self.rules)
        self[""] = b""

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = "".join(map(self.rules.byte.__getitem__, raw))
        return self.machine.push(symbols[:-1] + chr(0x4400 + raw[-1])) + self.machine.finish()

    def piece(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.rules.specials.split(text):
            if part in self.rules.special:
                ids.append(self.rules.special[part])
            else:
                clean = "".join(c.lower() for c in unicodedata.normalize("NFC", part)) if not part.isascii() else part.lower()
                for word in self.rules.words.findall(clean):
                    ids += self.word(word)
        return np.asarray(ids, "<u4").tobytes()

    def __missing__(self, text: str) -> bytes:
        ids = None
        if len(text) > 1 and "A" <= text[0] <= "Z":
            ids = self[text[0].lower() + text[1:]]
        elif len(text) > 1 and text[-1] in ".," and text[-2] < "ɐ" and text[-2] != "İ" and text[-2].isalpha():
            ids = self[text[:-1]] + self[text[-1]]
        else:
            ids = self.piece(text)
        if len(text) <= 64:
            self[text] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if len(self) > self.most:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


class Decoder:
    """Takes ids in portions; the state is whether a token came before, and the bytes of an unfinished character."""

    def __init__(self, rules: Rules):
        plain = {c: b for b, c in enumerate(byte_alphabet())}
        self.names = {i: t.encode() for i, t in rules.names.items()}
        self.bytes = {i: t.encode() if t in rules.special else bytes(plain[c] for c in t.removesuffix(END)) + b" " * t.endswith(END) for i, t in rules.names.items()}
        self.reset()

    def reset(self) -> None:
        self.begun, self.utf8 = False, codecs.getincrementaldecoder("utf-8")("replace")

    def joined(self, ids: list[int]) -> bytes:
        out = b" ".join(map(self.names.__getitem__, ids))
        before, self.begun = self.begun, self.begun or bool(ids)
        return b" " + out if before and ids else out

    def text(self, ids: list[int], final: bool = False) -> str:
        return self.utf8.decode(b"".join(map(self.bytes.__getitem__, ids)), final)


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(path: str) -> tuple[Encoder, Decoder]:
    if path not in _LOADED:
        encode = Encoder(path)
        _LOADED[path] = encode, Decoder(encode.rules)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer: str, portion: int = 65_536) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (bytes of the library's decoded text) for each row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = loaded(tokenizer)
        for batch in batches:
            ids = [encode.ids(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([_decoded(decode, x, portion) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def _decoded(decode: Decoder, ids: bytes, portion: int) -> bytes:
    decode.reset()
    return b"".join(decode.joined(np.frombuffer(ids[at : at + 4 * portion], "<u4").tolist()) for at in range(0, len(ids), 4 * portion))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the digests are taken beside the operator's texts, in the task."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = loaded(tokenizer)
        for batch in batches:
            ids = [encode.ids(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(_decoded(decode, x, 65_536)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
