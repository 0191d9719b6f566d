"""Token counts, the transducer, id files and packing, each against the public library."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import common, id_files, packing, token_counts, transducer
from tallyloom.llm.encoding import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", " ", "\n", "\t", "a", "B", "é", "é", "s", "re", "ing", "1", ".", ",", "'s", "'", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "\x1c", "\x85", "日", "😀", "́", "Σ", "ΑΣ", "क़", "!"]


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def strings(n, seed=3):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12))) for _ in range(n)]
    out += [f"re{chr(c)}in{m}" for c in range(33, 0x250) for m in ("", ".", ",%%%", "_-")]
    return out + ["".join(r.choice("abinthe") for _ in range(k)) for k in (50, 400, 3000)] + ["a" * 5000, "ab" * 3000]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_library(path):
    ours, theirs = PieceEncoder(path, most=2000), library(path)
    for s in strings(3000):
        assert ids_of(ours.ids(s)) == theirs(s), s


def test_transducer_equals_library():
    encode, decode = transducer.loaded(WORD)
    theirs, whole = library(WORD), Tokenizer.from_file(WORD)
    for s in strings(3000, 5):
        ids = theirs(s)
        assert ids_of(encode.ids(s)) == ids, s
        assert transducer._decoded(decode, encode.ids(s), 3).decode() == whole.decode(ids, skip_special_tokens=False)


def test_transducer_streams_and_emits_early():
    rules = transducer.loaded(WORD)[0].rules
    machine, out, held = transducer.Transducer(rules), [], 0
    symbols = "".join(rules.byte[ord(c)] for c in "thein" * 20_000)
    for a in range(0, len(symbols), 999):
        out += machine.push(symbols[a : a + 999])
        held = max(held, len(machine.tail))
    assert held <= rules.lookahead() + 999
    assert "".join(rules.names[i] for i in out + machine.finish()) == "thein" * 20_000


def test_bytes_decode_to_text():
    encode, decode = transducer.loaded(WORD)
    decode.reset()
    ids = ids_of(encode.ids("straße 日本 x"))
    assert "".join(decode.text([i]) for i in ids) + decode.text([], True) == "straße 日本 x "


def test_encode_decode_rows(spark, odd_docs, no_docs):
    whole = Tokenizer.from_file(WORD)
    texts = [r.text for r in odd_docs.collect()]
    got = transducer.encode_decode(odd_docs, WORD).collect()
    assert [ids_of(r.ids) for r in got] == [library(WORD)(t) for t in texts]
    assert [r.decoded.decode() for r in got] == [whole.decode(ids_of(r.ids), skip_special_tokens=False) for r in got]
    for r, d in zip(got, transducer.digests(odd_docs, WORD).collect()):
        assert (d.doc_id, d.ids_sha256, d.decoded_sha256) == (r.doc_id, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest())
    assert transducer.digests(no_docs, WORD).count() == 0


def test_token_counts_use_the_cache(spark, odd_docs, no_docs):
    cache = f"{common.scratch(spark)}/cache-{uuid.uuid4().hex}"
    assert token_counts.token_counts(no_docs, BYTE, cache).count() == 0
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(library(BYTE)(r.text))) for r in odd_docs.collect())
    for _ in range(2):
        got = token_counts.token_counts(odd_docs, BYTE, cache, limit=1024).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        stored = token_counts.read_cache(spark, cache)
        assert stored.count() == stored.select("digest").distinct().count() == odd_docs.fillna("", ["text"]).select("text").distinct().count()
    token_counts.token_counts(odd_docs, WORD, cache).count()
    assert token_counts.read_cache(spark, cache).select("tokenizer").distinct().count() == 2


def test_id_files_round_trip(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        path = f"{common.scratch(spark)}/ids-{uuid.uuid4().hex}"
        id_files.write_ids(docs, WORD, path, rows_per_bucket=4, shard_bytes=200)
        got = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        place = 0
        for r, row in zip(got, rows):
            ids = [*library(WORD)(row.text), 1]
            assert (ids_of(r.ids), r.start, r.n_tokens, r.ids_crc32) == (ids, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            place += len(ids)


def test_packing_covers_every_id_once(spark, odd_docs, no_docs):
    assert packing.pack(no_docs, WORD).count() == 0
    got = packing.pack(odd_docs.repartition(3), WORD, window=64, shard_rows=5, portion=4000).toPandas()
    assert sorted(map(str, got)) == sorted(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]]
        total = s.length.sum()
        assert total <= 64 and total & (total - 1) == 0
    one = got[got.doc_id == 11].sort_values("start")
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in one.ids]).tolist()
    assert ids == [*library(WORD)("word " * 6000), 1] and list(one.start) == [0, *one.length.cumsum()[:-1]]
    assert got.length.sum() == sum(len(library(WORD)(r.text)) + 1 for r in odd_docs.collect())
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())
    again = packing.pack(odd_docs.coalesce(1), WORD, window=64, shard_rows=5, portion=4000).toPandas()
    key = ["sequence_id", "offset"]
    assert got.sort_values(key).ids_crc32.tolist() == again.sort_values(key).ids_crc32.tolist()


def test_packing_prefers_neighbours():
    units = [np.array([1, 2, 3, 4] * 4, np.uint32), np.array([50, 51, 52, 53] * 4, np.uint32), np.array([1, 2, 3, 9] * 4, np.uint32)]
    rows = packing.plan([16, 16, 16], packing.Index(units, 24), 32)
    assert [u for u, *_ in rows[0]] == [0, 2]


def test_packing_finds_neighbours_of_the_whole_corpus(spark):
    """Documents of a topic meet in a sequence though there are many shards."""
    r = random.Random(4)
    words = [w for w in library_words() if w]
    topics = [r.sample(words, 12) for _ in range(40)]
    docs = [(i, " ".join(r.choices(topics[i % 40], k=20))) for i in range(160)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), WORD, window=64, shard_rows=16).toPandas()
    assert (got.sequence_id // (1 << 28)).nunique() >= 8
    # Three of a topic's four documents fill a sequence; what the fourth meets is chance.
    first = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").doc_id.apply(list)
    met = {s[0] % 40 for s in first if len(s) > 1 and s[0] % 40 == s[1] % 40}
    assert len(met) >= 34


def library_words():
    vocabulary = Tokenizer.from_file(WORD).get_vocab()
    return sorted(w[:-4] for w in vocabulary if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and len(w) > 8)[:4000]
