"""Packing by lexical retrieval.

Documents are encoded once, and terms' document frequencies, the number of documents and their mean length are taken over the
whole corpus. Documents are dealt to shards by what they say: a tree over projections of their BM25 weights, fitted on a sample
spread over the corpus, splits it along the direction in which texts differ most, at a wide gap, until a shard holds at most
``shard_rows`` documents. Texts that it can't tell apart and that are too many for a shard (copies) are dealt by a hash. The sample and
the tree are bounded: a tree has 4096 leaves at most, and where a leaf still holds several shards it gets such a tree of its own,
grown and applied on Spark (two levels: 17 million shards, 34 billion documents; beyond them, leaves are dealt by a hash).

Each shard has a BM25 inverted index of its documents' token ids, weighed by the corpus' statistics. A seed document (the next
unused in order) asks it for its neighbours; the unused ones, best first, fill the seed's window as far as they fit whole,
and what room is left is filled by cutting the best neighbour that doesn't fit, whose rest stays unused. Where no neighbour
shares a term, the next unused document in order stands in. A document of a whole window or more gives up whole windows
first; its rest is packed. The last window of a shard, if not full, is cut into sequences whose lengths are powers of two, so
nothing is padded.

A query uses all terms of its seed (with ``terms``, those that weigh most); scores cover every document of the shard. Neighbours
that the tree put into another shard aren't found: README has the measured recall.

Cases: null and empty texts are the end id alone; rows with equal doc_id are packed apart; a null doc_id is kept; a shard of
long texts is packed in portions of ``portion`` ids to bound memory; an empty table packs to nothing; other columns are
ignored. Results don't depend on how the input was partitioned: dealing uses whole numbers only.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ready, saved, spread
from .encoding import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
K1, B = 1.2, 0.75  # BM25's usual constants


class Stats:
    """What BM25 needs to know of all units: their number, mean length and each term's document frequency."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, max(1.0, mean)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    def weight(self, unit: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / self.mean))[unit].astype(np.float32))


def _postings(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit, term and frequency of each distinct term of each unit, in order; and the units' lengths."""
    n, lengths = len(units), np.array([len(u) for u in units], np.int64)
    keys = np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(16), lengths) | (np.concatenate(units) if n else np.zeros(0, np.uint32))
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=np.uint32(0)).astype(bool) | (np.arange(len(keys)) == 0))
    tf = np.diff(np.append(first, len(keys))).astype(np.float32)
    return (keys[first] >> np.uint32(16)).astype(np.int64), (keys[first] & np.uint32(0xFFFF)).astype(np.int64), tf, lengths


class Index:
    """Inverted BM25 index over units (arrays of token ids), term-major; weighed by their own statistics if none are given."""

    def __init__(self, units: list[np.ndarray], terms: int | None = None, stats: Stats | None = None):
        self.terms, n = terms, len(units)
        unit, term, tf, lengths = _postings(units)
        df = np.bincount(term, minlength=1 << 16)
        stats = stats or Stats(n, lengths.mean() if n else 1.0, df)
        idf, weight = stats.idf, stats.weight(unit, term, tf, lengths)
        self.rows = np.searchsorted(unit, np.arange(n + 1))
        self.by_unit = term, (idf[term] * np.where(df[term] > 1, 1, 0)).astype(np.float32)
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.posted, self.weight, self.heads = unit[order], weight[order], np.concatenate([[0], np.cumsum(df)])
        self.n, self.columns = n, np.arange(n)
        common = np.flatnonzero(3 * df > n)  # terms of a third of the units: a row of weights each, at most thrice their postings
        self.row, self.dense = np.full(1 << 16, -1), np.zeros((len(common), n))
        self.row[common] = np.arange(len(common))
        for row, term in enumerate(common.tolist()):
            span = slice(self.heads[term], self.heads[term + 1])
            self.dense[row, self.posted[span]] = self.weight[span]

    def scores(self, unit: int) -> np.ndarray:
        a, b = self.rows[unit], self.rows[unit + 1]
        term, value = self.by_unit[0][a:b], self.by_unit[1][a:b]
        if self.terms and b - a > self.terms:
            term = term[np.argpartition(-value, self.terms)[: self.terms]]
        row = self.row[term]
        out = np.zeros(self.n)
        out[self.columns] = self.dense[row[row >= 0]].sum(0)
        rare = term[row < 0]
        if len(rare):
            spans = [slice(a, b) for a, b in zip(self.heads[rare].tolist(), self.heads[rare + 1].tolist())]
            out += np.bincount(np.concatenate([self.posted[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out

    def keep(self, units: np.ndarray) -> None:
        """Leaves the postings of some units only (a mask); the others' scores become 0."""
        some = units[self.posted]
        self.heads = np.concatenate([[0], np.cumsum(some)])[self.heads]
        self.posted, self.weight = self.posted[some], self.weight[some]
        self.dense, self.columns = self.dense[:, units[self.columns]], np.flatnonzero(units)


def plan(lengths: list[int], index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, start in it, length); all are full but the last."""
    left = np.array(lengths, np.int64)
    done = np.zeros(len(left), np.int64)
    out, seed, held = [], 0, len(left)
    while True:
        while seed < len(left) and not left[seed]:
            seed += 1
        if seed == len(left):
            return out
        row, room, unused = [], window, np.count_nonzero(left)
        if unused < 0.85 * held:  # used units need no scores
            index.keep(left > 0)
            held = unused

        def put(unit: int, n: int) -> None:
            nonlocal room
            row.append((unit, int(done[unit]), n))
            done[unit] += n
            left[unit] -= n
            room -= n

        put(seed, int(min(left[seed], room)))
        if room:
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & (left > 0))
            near = near[np.argsort(-score[near], kind="stable")]
            while room:
                fit = np.flatnonzero((left[near] <= room) & (left[near] > 0))
                if not len(fit):
                    break
                put(int(near[fit[0]]), int(left[near[fit[0]]]))
            rest = near[left[near] > 0]
            if room and len(rest):
                put(int(rest[0]), room)
            for unit in range(seed, len(left)) if room else ():
                if left[unit]:
                    put(unit, int(min(left[unit], room)))
                if not room:
                    break
        out.append(row)


def cut(row: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A full sequence as it is, another as sequences of powers of two."""
    total, out = sum(n for *_, n in row), []
    if total == window:
        return [row]
    row = row[::-1]
    for bit in reversed(range(total.bit_length())):
        if need := total & (1 << bit):
            out.append([])
            while need:
                unit, start, n = row.pop()
                if n > need:
                    row.append((unit, start + need, n - need))
                    n = need
                out[-1].append((unit, start, n))
                need -= n
    return out


def _portion(shard: int, first: int, docs: list[tuple[int | None, np.ndarray]], window: int, terms: int | None, stats: Stats, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    sequences, units, places = [], [], []
    for k, (_, ids) in enumerate(docs):
        whole = len(ids) - len(ids) % window
        sequences += [[(k, a, window)] for a in range(0, whole, window)]
        if len(ids) > whole:
            units.append(ids[whole:])
            places.append((k, whole))
    for row in plan([len(u) for u in units], Index(units, terms, stats), window):
        sequences += cut([(places[u][0], places[u][1] + a, n) for u, a, n in row], window)
    rows = []
    for number, sequence in enumerate(sequences, first):
        offset = 0
        for k, start, n in sequence:
            doc_id, ids = docs[k]
            piece = ids[start : start + n].astype("<u4").tobytes()
            rows.append((doc_id, start, n, zlib.crc32(piece), len(ids), (shard << 28) + number, offset, piece if with_ids else None))
            offset += n
    columns = list(zip(*rows))
    types = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in PIECE.split(", ")]), first + len(sequences)


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([end_id], "<u2").tobytes()
        for batch in blocks(batches, "text", 1 << 20):
            ids = [np.frombuffer(encode(t), "<u4") for t in batch.column("text").to_pylist()]
            if any(len(i) and i.max() >> 16 for i in ids):
                raise ValueError("token ids beyond 65,535")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype("<u2").tobytes() + end for i in ids], pa.binary())], ["doc_id", "ids"])

    return run


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(i, "<u2").astype(np.uint32) for i in column.to_pylist()]


def _rest(ids: np.ndarray, window: int) -> np.ndarray:
    """What is packed of a document beside its whole windows."""
    return ids[len(ids) - len(ids) % window :]


def _count(window: int):
    """A task's document frequencies; under term -1 its units, -2 their ids, -3 its rows and -4 their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(1 << 16, np.int64), np.zeros(4, np.int64)
        for batch in blocks(batches, "ids", 1 << 20):
            docs = _ids(batch.column("ids"))
            units = [u for u in (_rest(d, window) for d in docs) if len(u)]
            df += np.bincount(_postings(units)[1], minlength=1 << 16)
            totals += [len(units), sum(map(len, units)), len(docs), sum(map(len, docs))]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2, -3, -4])), pa.array(np.append(df[some], totals))], ["term", "n"])

    return run


DIMS = 64


def _vectors(units: list[np.ndarray], stats: Stats) -> np.ndarray:
    """Random projections (of whole numbers, so that no order of sums matters) of the units' weights, scaled to one length."""
    signs = _SIGNS[0] if _SIGNS else _SIGNS.append(np.random.default_rng(8).choice(np.array([-1, 1], np.float32), (1 << 16, DIMS))) or _SIGNS[0]
    unit, term, tf, lengths = _postings(units)
    out = np.zeros((len(units), DIMS), np.int64)
    if len(unit):
        weight = np.rint(64 * np.sqrt(stats.weight(unit, term, tf, lengths)))
        heads = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        for k, (a, b) in enumerate(zip(heads, heads[1:])):
            exact = np.float32 if b - a < 1 << 14 else np.float64  # sums of whole numbers under 2^24 and 2^53
            out[k] = weight[a:b].astype(exact) @ signs[term[a:b]]
    return np.rint(out * (1000 / np.sqrt(np.maximum(1, (out * out).sum(1))))[:, None]).astype(np.int64)


_SIGNS: list[np.ndarray] = []


class Tree:
    """Shards of vectors. Inner nodes have a direction and the least product of their right side; leaves have shards.

    With ``most`` leaves already, what is left stays in one leaf of several shards, which a tree of its own can split further.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, rows: int, shard_rows: int, portion: int, most: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        total = max(rows / shard_rows, sizes.sum() * rows / max(1, len(vectors)) / portion)
        least = max(1, total / most)  # shards in a leaf
        scale = rows / max(1, len(vectors))

        def grow(at: np.ndarray) -> int:
            me = len(self.nodes)
            self.nodes.append(())
            need = int(np.ceil(max(len(at) * scale / shard_rows, sizes[at].sum() * scale / portion)))
            x = vectors[at]
            direction = np.rint(1000 * np.linalg.eigh(np.cov(x.T))[1][:, -1]).astype(np.int64) if need > least and len(at) > 1 else np.zeros(DIMS, np.int64)
            product = np.sort(x @ direction)
            gaps = np.diff(product)
            middle = slice(int(len(gaps) * 0.3), max(int(len(gaps) * 0.7), int(len(gaps) * 0.3) + 1))
            if need > least and gaps.any():
                k = int(gaps[middle].argmax()) + middle.start if gaps[middle].any() else int(gaps.argmax())
                right = x @ direction >= product[k + 1]
                self.nodes[me] = (direction, int(product[k + 1]), grow(at[~right]), grow(at[right]))
            else:
                self.nodes[me] = (self.shards, max(1, need))
                self.shards += max(1, need)
            return me

        grow(np.arange(len(vectors)))

    def wide(self) -> list[tuple[int, int]]:
        """Leaves of several shards: the first, and how many."""
        return [n for n in self.nodes if len(n) == 2 and n[1] > 1]

    def place(self, vectors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if len(self.nodes[node]) == 2:
                first, parts = self.nodes[node]
                out[at] = first + hashes[at] % parts
            elif len(at):
                direction, least, left, right = self.nodes[node]
                side = vectors[at] @ direction >= least
                todo += [(left, at[~side]), (right, at[side])]
        return out


def _sample(window: int, stats: Stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "ids", 1 << 18):
            docs = _ids(batch.column("ids"))
            vectors = _vectors([_rest(d, window) for d in docs], stats).astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([len(d) for d in docs], pa.int64())], ["vector", "size"])

    return run


def deal(encoded: DataFrame, window: int, shard_rows: int, portion: int, sample: int = 1 << 16) -> tuple[DataFrame, int, Stats]:
    """``encoded`` (doc_id, ids) with its shard, the number of shards, and the corpus' statistics."""
    counts = encoded.mapInArrow(_count(window), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(counts.term.tolist(), counts.n.tolist()))
    units, unit_ids, rows, ids = (int(n.pop(k, 0)) for k in (-1, -2, -3, -4))
    df = np.zeros(1 << 16, np.int64)
    df[list(n)] = list(n.values())
    stats = Stats(units, unit_ids / max(1, units), df)
    most = max(1, portion // 2)  # ids of a shard, so that few shards are cut into portions
    need = max(rows / shard_rows, ids / most)
    if need <= 1:
        return encoded.select(F.lit(0).cast("long").alias("shard"), "doc_id", "ids"), 1, stats
    # The sample, and with it the tree, is bounded; leaves of several shards get trees of their own in a second level, on Spark.
    rate = min(1.0, max(4096, min(sample, 16 * need)) / rows)
    tree = _tree([(r.vector, r.size) for r in _chosen(encoded, F.lit(rate)).select("ids").mapInArrow(_sample(window, stats), "vector binary, size long").collect()], rows, shard_rows, most, sample)
    dealt = encoded.mapInArrow(_route(window, stats, tree), DEALT)
    if need > sample // 16 and tree.wide():
        dealt = _second(saved(dealt, "dealt"), tree.wide(), window, stats, shard_rows, most, sample)
    return dealt, tree.shards, stats


def _chosen(rows: DataFrame, rate: F.Column) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < (rate * (1 << 30)).cast("long"))


def _second(dealt: DataFrame, cells: list[tuple[int, int]], window: int, stats: Stats, shard_rows: int, most: int, sample: int) -> DataFrame:
    """``dealt`` with the shards of each cell (first shard, number of shards; at most ``sample`` / 16 of them) dealt by a tree of the cell's own
    instead of a hash. A tree goes to the tasks that hold its cell as a row before the documents'."""
    spark = dealt.sparkSession
    names = spark.createDataFrame(cells, "cell long, parts long")
    shards = names.select("cell", "parts", F.explode(F.sequence(F.col("cell"), F.col("cell") + F.col("parts") - 1)).alias("shard"))
    placed = dealt.join(shards, "shard", "left")
    sizes = placed.where("cell is not null").groupBy("cell").agg(F.count("*").alias("rows"))
    rate = F.least(F.lit(1.0), F.greatest(F.lit(4096), F.least(F.lit(sample), 16 * F.col("parts"))) / F.col("rows"))
    some = _chosen(placed.join(F.broadcast(sizes), "cell"), rate).select("cell", "rows", "ids")  # a row for each cell

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "ids", 1 << 18):
            docs = _ids(batch.column("ids"))
            found = _vectors([_rest(d, window) for d in docs], stats).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("rows"), pa.array([v.tobytes() for v in found], pa.binary()), pa.array([len(d) for d in docs], pa.int64())], ["cell", "rows", "vector", "size"])

    def grow(table: pa.Table) -> pa.Table:
        own = _tree(list(zip(table["vector"].to_pylist(), table["size"].to_pylist())), table["rows"][0].as_py(), shard_rows, most, sample)
        return pa.table({"cell": table["cell"][:1], "tree": [pickle.dumps(own)]})

    trees = saved(some.mapInArrow(vectors, "cell long, rows long, vector binary, size long").groupBy("cell").applyInArrow(grow, "cell long, tree binary").join(names, "cell"), "trees")
    salts = F.ceil(F.col("parts") / 64)  # shards that one task deals
    heads = trees.select("cell", "parts", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "tree", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("ids"))
    rows = placed.where("cell is not null").select("cell", "parts", F.pmod(F.xxhash64("doc_id", "ids"), salts).alias("salt"), F.lit(None).cast("binary").alias("tree"), "doc_id", "ids")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in blocks(batches, "ids", 1 << 18):
            at = np.flatnonzero(np.asarray(batch.column("tree").is_valid())).tolist()
            for a, b in zip([0, *at], [*at, batch.num_rows]):
                if a in at:
                    tree, a = pickle.loads(batch.column("tree")[a].as_py()), a + 1
                for found in _route(window, stats, tree)(iter([batch.slice(a, b - a)])) if a < b else ():
                    part = batch.slice(a, found.num_rows)
                    shard = np.asarray(part.column("cell")) + np.asarray(found.column("shard")) % np.asarray(part.column("parts"))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), found.column("doc_id"), found.column("ids")], ["shard", "doc_id", "ids"])
                    a += found.num_rows

    cells_rows = rows.unionByName(heads).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("tree").isNull())
    return placed.where("cell is null").select("shard", "doc_id", "ids").unionByName(cells_rows.mapInArrow(route, DEALT))


DEALT = "shard long, doc_id long, ids binary"


def _tree(sample: list[tuple[bytes, int]], rows: int, shard_rows: int, most: int, limit: int) -> Tree:
    ordered = sorted((bytes(v), n) for v, n in sample)
    vectors = np.frombuffer(b"".join(v for v, _ in ordered), "<i2").astype(np.int64).reshape(-1, DIMS)
    return Tree(vectors, np.array([n for _, n in ordered], np.int64), rows, shard_rows, most, max(1, limit // 16))


def _route(window: int, stats: Stats, tree: Tree):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "ids", 1 << 18):
            vectors = _vectors([_rest(d, window) for d in _ids(batch.column("ids"))], stats)
            hashes = np.array([zlib.crc32(str(d).encode()) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tree.place(vectors, hashes)), batch.column("doc_id"), batch.column("ids")], ["shard", "doc_id", "ids"])

    return route


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_rows: int = 2048, portion: int = 6_000_000, terms: int | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of all sequences (PIECE): each id of each document (doc_id, text; and an end id) lies in one of them."""
    ready(docs.sparkSession)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    encoded = saved(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids binary"), "packing-ids")
    dealt, shards, stats = deal(encoded, window, shard_rows, portion)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, size, held = None, 0, 0, []
        for batch in batches:
            for shard, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), _ids(batch.column("ids"))):
                if held and (shard != now or size > portion or len(held) == 1 << 16):
                    out, number = _portion(now, number, held, window, terms, stats, with_ids)
                    yield out
                    number, size, held = number if shard == now else 0, 0, []
                elif shard != now:
                    number = 0
                now = shard
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield _portion(now, number, held, window, terms, stats, with_ids)[0]

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(run, PIECE)
