"""TIFF media columns: writing bytes as greyscale pages, and reading pages back.

The reader walks the chain of image directories, finds strips or tiles, decodes them (none, PackBits, LZW, deflate), undoes
the horizontal and the floating-point predictor and puts tiles and planes together, at 1, 8, 16 or 32 bits a sample. ``pages`` emits one row per page. The writer stores 8-bit samples in
pages of ``PAGE_ROWS`` rows of 64, in strips, with any of those compressions; long payloads take several pages.

Cases: null media gives no pages; media that isn't TIFF gives one row with ``error`` set and no samples, a
page that is cut short or unknown such a row after the pages before it;
null and empty texts are stored as 64 zero bytes; extra columns are ignored; repeated rows give equal rows; an empty table
gives an empty result; loops among directories end at the first directory met again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, ready

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 16_384, 1024
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Fixed values of the format: tag numbers, and bytes per value of each field type.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279, "planar": 284, "format": 339, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, data binary, error string"


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


CLEAR, STOP = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, widened one code early."""
    codes: dict[bytes, int] = {}
    bits, held, out, width = 0, 0, bytearray(), 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            out.append((bits >> (held - 8)) & 255)
            held -= 8
        bits &= (1 << held) - 1

    def reset() -> None:
        nonlocal width
        put(CLEAR)
        codes.clear()
        codes.update({bytes((b,)): b for b in range(256)})
        width = 9

    codes.update({bytes((b,)): b for b in range(256)})
    reset()
    run = b""
    for b in data:
        more = run + bytes((b,))
        if more in codes:
            run = more
            continue
        put(codes[run])
        codes[more] = len(codes) + 2
        if codes[more] == 4093:
            run = bytes((b,))
            reset()
            continue
        width = max(9, (codes[more] + 1).bit_length())
        run = bytes((b,))
    if run:
        put(codes[run])
        width = max(9, (len(codes) + 2 + 1).bit_length())
    put(STOP)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    first = [bytes((b,)) for b in range(256)] + [b"", b""]
    entries, out, bits, held, width, before = first[:], bytearray(), 0, 0, 9, None
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            entries, width, before = first[:], 9, None
            continue
        if before is None:
            entry = entries[code]
        else:
            if code > len(entries):
                raise ValueError("LZW code out of range")
            entry = entries[code] if code < len(entries) else before + before[:1]
            entries.append(before + entry[:1])
        out += entry
        before = entry
        width = min(12, max(9, (len(entries) + 1).bit_length()))
    return bytes(out)


def _squeeze(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def _expand(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    return {NONE: bytes, PACKBITS: unpack_bits, LZW: unlzw}[compression](data)


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """Pages of 8-bit grey samples, 64 to a row; ``tile`` > 0 stores square tiles of that side in place of strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for at in range(0, max(1, len(payload)), WIDTH * PAGE_ROWS):
        image = np.frombuffer(payload[at : at + WIDTH * PAGE_ROWS], np.uint8).reshape(-1, WIDTH)
        height = len(image)
        if tile:
            padded = np.pad(image, ((0, -height % tile), (0, -WIDTH % tile)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = _squeeze(part.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        fields = {"width": [WIDTH], "height": [height], "bits": [8], "compression": [compression], "photometric": [1], "samples": [1], "predictor": [predictor]}
        fields |= {"tile_width": [tile], "tile_height": [tile], "tile_offsets": offsets, "tile_counts": counts} if tile else {"strip_offsets": offsets, "rows_per_strip": [STRIP_ROWS], "strip_counts": counts}
        entries = []
        for name, values in sorted(fields.items(), key=lambda f: TAGS[f[0]]):
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", TAGS[name], 4, len(values)) + raw)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * i
        if SIZES[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _samples(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """The samples of a strip or tile, as numbers, with the predictor undone."""
    if bits == 1:
        line = -(-width * samples // 8)
        packed = np.frombuffer(raw, np.uint8)[: rows * line].reshape(rows, line)
        return np.unpackbits(packed, axis=1)[:, : width * samples].reshape(rows, width, samples)
    size = bits // 8
    flat = np.frombuffer(raw, np.uint8)[: rows * width * samples * size]
    if predictor == 3:  # bytes of like weight stand together, highest first, and hold differences to the byte ``samples`` before
        shifts = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(shifts.reshape(rows, size, width * samples).transpose(0, 2, 1)).view(f">u{size}").reshape(rows, width, samples)
    part = flat.view(f"{order}u{size}").reshape(rows, width, samples)
    return np.cumsum(part, axis=1, dtype=f"u{size}") if predictor == 2 else part


MOST_GROWTH = 4096  # bytes that one byte can stand for, at most, in the compressions read


def read_tiff(data: bytes) -> Iterator[dict]:
    """The pages: width, height, samples, bits, compression, predictor and the samples' bytes (a byte each at 1 and 8 bits, else little-endian)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        fields, at = _directory(data, at, order)
        one = lambda name, default=None: fields.get(TAGS[name], [default])[0]  # noqa: E731, B023
        width, height, samples, predictor, compression = one("width"), one("height"), one("samples", 1), one("predictor", 1), one("compression", 1)
        bits, planes = one("bits", 1), samples if one("planar", 1) == 2 else 1
        if set(fields.get(TAGS["bits"], [1])) != {bits} or bits not in (1, 8, 16, 32):
            raise ValueError("samples are read at 1, 8, 16 or 32 bits, all alike")
        tiled = TAGS["tile_offsets"] in fields
        w, h = (one("tile_width"), one("tile_height")) if tiled else (width, min(one("rows_per_strip", height), height))
        kind = "tile" if tiled else "strip"
        if min(width, height, samples, w, h) < 1 or predictor not in (1, 2, 3) or predictor == 2 and bits == 1 or predictor == 3 and bits not in (16, 32):
            raise ValueError("a size of 0 or an unknown predictor")
        if max(width * height, w * h) * samples * bits > 8 * MOST_GROWTH * len(data):
            raise ValueError("more samples than the file can hold")
        if min(len(fields[TAGS[f"{kind}_{x}"]]) for x in ("offsets", "counts")) < planes * -(-width // w) * -(-height // h):
            raise ValueError(f"a {kind} is missing")
        image = np.zeros((height, width, samples), f"<u{max(1, bits // 8)}")
        across, each, own = -(-width // w), -(-width // w) * -(-height // h), samples // planes
        for i, (start, n) in enumerate(zip(fields[TAGS[f"{kind}_offsets"]], fields[TAGS[f"{kind}_counts"]])):
            if i == planes * each:
                break
            y, x, plane = i % each // across * h, i % each % across * w, i // each
            rows = h if tiled else min(h, height - y)
            part = _samples(_expand(data[start : start + n], compression), rows, w, own, bits, predictor, order)
            image[y : y + rows, x : x + w, plane * own : (plane + 1) * own] = part[: height - y, : width - x]
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "data": image.tobytes()}


def payload(text: bytes | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    text = text or b""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def encode_texts(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes and media (a TIFF file's bytes) for each row of ``docs`` (doc_id, text)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 23):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write_tiff(payload(t), compression, predictor) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _read(data: bytes | None) -> Iterator[dict]:
    """The pages up to the first that fails, and a row with the error in its place."""
    page = 0
    try:
        for p in read_tiff(data) if data is not None else ():
            yield {"page": page, "error": None} | p
            page += 1
    except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, ArithmeticError, MemoryError) as e:
        yield dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "data")) | {"page": page, "error": str(e) or type(e).__name__}


def pages(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per page of each row of ``media`` (key, media)."""
    ready(media.sparkSession)
    names = [c.split()[0] for c in PAGE.split(", ")]
    types = [pa.int32()] * 7 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", 1 << 23):
            rows = [(k, p) for k, m in zip(batch.column(key).to_pylist(), batch.column("media").to_pylist()) for p in _read(m)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(key).type), *(pa.array([p[n] for _, p in rows], t) for n, t in zip(names, types))], [key, *names])

    return media.select(key, "media").mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, {PAGE}")


def feature(found: list[dict]) -> str:
    """Pages, size and grey statistics over all samples: mean, deviation, share of zeros and the commonest value."""
    counts = sum((np.bincount(np.frombuffer(p["data"], np.uint8), minlength=256) for p in found), np.zeros(256, np.int64))
    n, values = int(counts.sum()), np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    return f"pages={len(found)};width={found[0]['width']};rows={sum(p['height'] for p in found)};mean={mean:.3f};sd={spread:.3f};zeros={counts[0] / n:.4f};mode={int(counts.argmax())}"


def stored_features(docs: DataFrame) -> DataFrame:
    """Stores each text as TIFF, reads the stored bytes back, and gives digests and features of what was read.

    The digests of a file and of its pages' samples are taken in the task that reads the file.
    """
    media = encode_texts(docs)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", 1 << 23):
            rows = []
            for n, m in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                found = list(read_tiff(m))
                data = b"".join(p["data"] for p in found)
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return media.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
