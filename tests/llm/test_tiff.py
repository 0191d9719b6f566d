"""Round trips through every compression, strips and tiles, both byte orders; damaged files; features."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tallyloom.llm import tiff

R = random.Random(4)
PAYLOADS = [b"\0" * 64, bytes(R.randrange(256) for _ in range(64 * 50)), b"abcabcabcd" * 64 * 20, b"a" * 64 * 700, ("ünï " * 4000).encode().ljust(64 * 400, b"\0")]


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    for p in PAYLOADS:
        got = list(tiff.read_tiff(tiff.write_tiff(p, compression, predictor, tile, order)))
        assert b"".join(g["data"] for g in got) == p
        assert (got[0]["width"], got[0]["compression"], got[0]["predictor"]) == (64, compression, predictor)


def test_many_pages():
    p = bytes(64) * (tiff.PAGE_ROWS * 2 + 3)
    got = list(tiff.read_tiff(tiff.write_tiff(p)))
    assert [g["height"] for g in got] == [tiff.PAGE_ROWS, tiff.PAGE_ROWS, 3]


def test_known_codes():
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    for n in (3000, 70_000):
        data = bytes(R.randrange(7) for _ in range(n))
        assert tiff.unlzw(tiff.lzw(data)) == data


def test_samples_of_three_colours_with_predictor():
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    raw = np.diff(image, axis=1, prepend=np.zeros((5, 1, 3), np.uint8)).tobytes()
    fields = [(256, 3, 1, 7), (257, 3, 1, 5), (258, 3, 3, 134), (259, 3, 1, 1), (273, 4, 1, 140), (277, 3, 1, 3), (278, 3, 1, 5), (279, 4, 1, len(raw)), (317, 3, 1, 2)]
    head = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHI", *f[:3]) + (struct.pack("<HH", f[3], 0) if f[1] == 3 and f[2] == 1 else struct.pack("<I", f[3])) for f in fields) + struct.pack("<I", 0)
    data = head.ljust(134, b"\0") + struct.pack("<HHH", 8, 8, 8) + raw
    (page,) = tiff.read_tiff(data)
    assert page["data"] == image.tobytes() and page["samples"] == 3


def test_pages_of_rows(spark):
    good = tiff.write_tiff(b"x" * 64)
    rows = [(1, bytearray(good), "e"), (2, None, "e"), (3, bytearray(b"junk"), "e"), (4, bytearray(good[:-30]), "e"), (5, bytearray(b""), "e")]
    media = spark.createDataFrame(rows, "doc_id long, media binary, error string")
    got = {r.doc_id: r for r in tiff.pages(media).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert bytes(got[1].data) == b"x" * 64 and got[1].error is None
    assert all(got[i].error and got[i].data is None for i in (3, 4, 5))


def test_stored_features(spark, odd_docs, no_docs):
    assert tiff.stored_features(no_docs).count() == 0
    seen = {}
    for row, r in zip(odd_docs.collect(), tiff.stored_features(odd_docs).collect()):
        raw = (row.text or "").encode()
        padded = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (row.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = tiff.write_tiff(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert seen.setdefault(row.text or "", r.feature) == r.feature


def test_malformed_headers_give_error_rows():
    good = tiff.write_tiff(tiff.payload(b"some text"), tiff.DEFLATE, 2)
    assert next(tiff._read(good))["error"] is None
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    for tag, value in ((tiff.TAGS["width"], 0), (tiff.TAGS["height"], 2**31), (tiff.TAGS["rows_per_strip"], 0), (tiff.TAGS["predictor"], 3), (tiff.TAGS["compression"], 9)):
        for i in range(n):
            entry = at + 2 + 12 * i
            if struct.unpack_from("<H", good, entry)[0] == tag:
                bad = bytearray(good)
                struct.pack_into("<HI", bad, entry + 2, 4, 1)
                struct.pack_into("<I", bad, entry + 8, value)
                assert next(tiff._read(bytes(bad)))["error"], tag


def made(image, bits, order="<", planar=1, predictor=1, floats=False, tile=0):
    """A file of one page in strips of three rows, or in tiles."""
    height, width, samples = image.shape
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")

    def raw(part):
        if bits == 1:
            return np.packbits(part.reshape(len(part), -1), axis=1).tobytes()
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
        if predictor == 3:
            planes = np.ascontiguousarray(part.astype(f">u{bits // 8}")).view(np.uint8).reshape(len(part), -1, bits // 8).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
            return np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()
        return part.astype(kind).tobytes()

    planes = [image[..., c : c + 1] for c in range(samples)] if planar == 2 else [image]
    if tile:
        grown = [np.pad(p, ((0, -height % tile), (0, -width % tile), (0, 0))) for p in planes]
        parts = [raw(p[y : y + tile, x : x + tile]) for p in grown for y in range(0, p.shape[0], tile) for x in range(0, p.shape[1], tile)]
    else:
        parts = [raw(p[y : y + 3]) for p in planes for y in range(0, height, 3)]
    fields = {"width": [width], "height": [height], "bits": [bits] * samples, "compression": [1], "samples": [samples], "planar": [planar], "predictor": [predictor], "format": [3 if floats else 1] * samples}
    out, starts = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), []
    for q in parts:
        starts.append(len(out))
        out += q
    fields |= {"tile_width": [tile], "tile_height": [tile], "tile_offsets": starts, "tile_counts": [len(q) for q in parts]} if tile else {"rows_per_strip": [3], "strip_offsets": starts, "strip_counts": [len(q) for q in parts]}
    entries = b""
    for name, values in sorted(fields.items(), key=lambda f: tiff.TAGS[f[0]]):
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > 4:
            packed, at = struct.pack(order + "I", len(out)), packed
            out += at
        entries += struct.pack(order + "HHI", tiff.TAGS[name], 4, len(values)) + packed
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(fields)) + entries + bytes(4))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("bits", "samples", "planar", "predictor", "tile"), [(1, 1, 1, 1, 0), (1, 3, 1, 1, 0), (16, 1, 1, 2, 0), (16, 3, 2, 2, 16), (8, 4, 2, 1, 0), (32, 1, 1, 1, 0), (32, 3, 1, 3, 0), (32, 2, 2, 3, 16), (16, 1, 1, 3, 0)])
def test_depths_planes_and_predictors(order, bits, samples, planar, predictor, tile):
    image = np.random.default_rng(bits + samples).integers(0, 1 << bits, (11, 21, samples), dtype=np.uint64).astype(f"u{max(1, bits // 8)}")
    (page,) = tiff.read_tiff(made(image, bits, order, planar, predictor, bits == 32, tile))
    assert page["data"] == image.astype(f"<u{max(1, bits // 8)}").tobytes()
    assert (page["width"], page["height"], page["samples"], page["bits"]) == (21, 11, samples, bits)


def test_a_faulty_page_keeps_those_before_it(spark):
    whole = tiff.write_tiff(bytes(range(64)) * (tiff.PAGE_ROWS + 9), tiff.NONE, 1)
    df = spark.createDataFrame([(1, whole[:-10]), (2, whole), (3, b"II*"), (4, None)], "doc_id long, media binary")
    got = [(r.doc_id, r.page, r.error is None, r.height) for r in tiff.pages(df).orderBy("doc_id", "page").collect()]
    assert got == [(1, 0, True, tiff.PAGE_ROWS), (1, 1, False, None), (2, 0, True, tiff.PAGE_ROWS), (2, 1, True, 9), (3, 0, False, None)]
