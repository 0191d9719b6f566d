"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Every passage is described by how its characters follow one another
(counts of pairs of character classes) and by how its words repeat, and encoded by a small dense layer. Gated attention
(tanh times sigmoid) weighs the passages, and the document's score comes from the weighted sum of their codes. Encoder,
attention and output are learned together from document labels by gradient descent.

The fit takes a bounded sample of labelled rows (``sample``), in one task; passages are described in parallel before it.

Cases: null, empty and blank texts are one passage without words; very long texts are scored whole, passage by passage;
equal texts get equal scores; repeated rows are each scored; null labels are left out and, of repeated ones, the largest
holds; with no labelled row every score is 1, so nothing is rejected; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, mix, ready, spread, word_hashes, word_spans
from .labels import in_one_task, sample_labelled

WORDS, HIDDEN, GATES = 64, 24, 12
CLASSES = 16
EXTRA = 5
WIDTH = CLASSES * CLASSES + EXTRA


def _classes() -> np.ndarray:
    out = np.full(256, 15, np.int64)
    out[128:] = 0
    for k, some in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "|", "!?", "#", "$%&*", "<>{}[]()=/\\", "\"'`", ":;-_@~^+"), 1):
        out[[ord(c) for c in some]] = k
    return out


_CLASS = _classes()


def describe(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH numbers for each passage, in order, and the number of passages of each text (one at least)."""
    data, starts, ends, counts = word_spans(texts)
    hashes, _ = word_hashes(texts)
    passages = np.maximum(1, -(-counts // WORDS))
    first = np.cumsum(passages) - passages
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(first, counts) + place // WORDS
    total = int(passages.sum())
    # A byte belongs to the passage of the last word begun before it in its text.
    begun = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    kind = _CLASS[data]
    owner = np.repeat(np.arange(len(texts)), [len(t or b"") + 1 for t in texts])  # the line end after a text is its last byte
    last = np.append(owner[1:] != owner[:-1], True)
    inside = np.flatnonzero((begun[1:] >= (np.cumsum(counts) - counts)[owner]) & ~last) + 1
    pairs = np.bincount(of[begun[inside]] * 256 + kind[inside] * 16 + kind[inside + 1], minlength=total * 256).reshape(total, 256) if len(starts) else np.zeros((total, 256))
    n_words = np.bincount(of, minlength=total)
    keys = np.unique(of.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32))
    distinct = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=total)
    length = np.bincount(of, ends - starts, total) / np.maximum(1, n_words)
    follow = np.flatnonzero((of[1:] == of[:-1]))
    twice = np.unique(of[follow].astype(np.uint64) << np.uint64(32) | mix(hashes[follow] * np.uint64(3) + hashes[follow + 1]) >> np.uint64(32))
    pairs_of = np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=total)
    extra = [n_words / WORDS, distinct / np.maximum(1, n_words), pairs_of / np.maximum(1, n_words - 1), length / 10, np.ones(total)]
    return np.hstack([np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True))), np.stack(extra, 1)]).astype(np.float32), passages


class Network:
    """Encoder, gated attention and output; ``parts`` holds the arrays."""

    SHAPES = {"e": (WIDTH, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "o": (HIDDEN,), "ob": (1,)}

    def __init__(self, parts: dict[str, np.ndarray] | None = None, seed: int = 11):
        r = np.random.default_rng(seed)
        self.parts = parts or {k: (r.standard_normal(s) / np.sqrt(s[0]) if len(s) > 1 or k in "ao" else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.parts
        first, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["e"] + p["eb"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        raw = (t * s) @ p["a"]
        weight = np.exp(raw - np.maximum.reduceat(raw, first)[of])
        weight /= np.add.reduceat(weight, first)[of]
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return h, t, s, weight, z, of, first, 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["ob"], -30, 30)))

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[-1]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        h, t, s, weight, z, of, first, out = self.forward(x, counts)
        d = (out - y).astype(np.float32) / len(y)
        dz = d[:, None] * p["o"]
        dweight = (dz[of] * h).sum(1)
        draw = weight * (dweight - np.add.reduceat(weight * dweight, first)[of])
        dg = draw[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (weight[:, None] * dz[of] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ draw, "o": z.T @ d, "ob": d.sum(keepdims=True)}


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, passes: int = 30, batch: int = 128, rate: float = 0.004, seed: int = 5) -> Network:
    """Adam over shuffled batches of documents, with a rate falling to zero."""
    net, r = Network(), np.random.default_rng(seed)
    first = np.cumsum(counts) - counts
    m, v = ({k: np.zeros(s, np.float32) for k, s in Network.SHAPES.items()} for _ in range(2))
    step, steps = 0, passes * -(-len(y) // batch)
    for _ in range(passes):
        order = r.permutation(len(y))
        for a in range(0, len(y), batch):
            some = order[a : a + batch]
            at = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in some])
            step += 1
            for k, g in net.gradients(x[at], counts[some], y[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.parts[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = 6_000) -> dict[str, np.ndarray] | None:
    ready(docs.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            x, counts = describe(batch.column("text").cast(pa.binary()).to_pylist())
            ends = np.cumsum(counts)
            rows = [x[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y = [], []
        for b in batches:
            bags += [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for x in b.column("x").to_pylist()]
            y += b.column("y").to_pylist()
        if bags:
            net = train(np.concatenate(bags).astype(np.float32), np.array([len(b) for b in bags]), np.array(y, np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(list(net.parts)), pa.array([v.astype("<f4").tobytes() for v in net.parts.values()], pa.binary())], ["part", "value"])

    rows = sample_labelled(docs, labels, column, sample).mapInArrow(featurise, "doc_id long, y int, x binary")
    parts = in_one_task(rows).mapInArrow(learn, "part string, value binary").collect()  # the network's arrays
    return {r.part: np.frombuffer(r.value, "<f4").reshape(Network.SHAPES[r.part]) for r in parts} or None


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and its score, 0 to 1, as column ``name``, which takes the place of one so named."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.drop(name).schema.add(name, "double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network({k: v.astype(float) for k, v in shared.value.items()}) if shared.value else None
        for batch in blocks(batches, "text", 1 << 20):
            scores = net.scores(*describe(batch.column("text").cast(pa.binary()).to_pylist())) if net else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(np.round(scores.astype(float), 9))], names)

    return docs.drop(name).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    docs = spread(docs.select("doc_id", "text"))
    scored = score(docs, fit(docs, labels, sample=sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
