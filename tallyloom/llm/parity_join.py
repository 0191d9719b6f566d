"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Sets are compared within size bands: documents whose sizes allow a similarity of
3/4 share a band, at most two bands each. In a band every set has a parity sketch of P parts: a shingle flips one bit of one
part, and what is kept of a part is the XOR of its odd bits' hashes. Each element of the symmetric difference flips one
bit, so two sketches differ in at most as many bits, and so in at most as many parts, as the sets' symmetric difference D.

For sizes a <= b and similarity 3/4, D <= (a + b) / 7 <= a / 3. So by the pigeonhole principle, if each set gives the first
floor(size / 3) + 1 of its non-empty parts as keys, linked sets share one: of the first parts up to where the set that is
done first is done, at most D differ. Sets with too few non-empty parts give all and a common marker, as two of them may
agree in empty parts only. The join finds a superset of all links; nothing is left to chance but 64-bit hashing.

A few keys more (``spare``) are given, so that as many crowded keys (those of passages that many documents share) may be
left out again: a set's crowded keys matter only if they outnumber its spare ones. Keys are dealt by hash to buckets as
blocks of numbers. Pairs under uncrowded keys are candidates. The sets whose crowded keys matter form groups, each under the
keys' smallest set, and are dealt anew by what sets them apart in their group (``_residual_keys``): with a centre (the shingles that
most of a few members have), two sets' symmetric difference is that of their residuals against the centre, in which the
shared passage cancels out; so the same pigeonhole argument holds for the residuals' elements, those outside the centre first. A
group's most central member is compared with all first, so that a cloud of near copies is one component before any pair is
formed. Of the elements, those rare in the group come first, and two sets are a candidate only if the places of a shared element allow
it for a first shared one (``_apart_under_keys``). Keys outside the centre that are crowded again make the groups of a second level.

All pairs pass a test of sizes and of the Hamming distance of a second, dense parity sketch of 2048 bits (of 16,384 for large sets)
before texts are moved.

Cases: documents without words (or null) have an empty set and link with nothing; with fewer words than a shingle, all words
are the one shingle; equal texts and rows that repeat a doc_id are linked by their sets; rows with a null doc_id
take part and lend no id; very long texts are read whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, mix, planes, ready, saved, spread, unplanes, unused, word_hashes
from .graphs import components

NUM, DEN = 75, 100  # links need DEN * intersection >= NUM * union
CROWD = 16
_WEIGHTS = np.array([pow(0xBF58476D1CE4E5B9, i + 1, 1 << 64) for i in range(64)], np.uint64)


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        sums = hashes[:n] * _WEIGHTS[0]
        for i in range(1, words):
            sums = sums + hashes[i : n + i] * _WEIGHTS[i]
        sums = mix(sums)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(sums[end - n : end - words + 1]))
        else:
            out.append(mix((hashes[end - n : end] * _WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def _entity(s: np.ndarray) -> int:
    return int(mix(s.sum(keepdims=True) * np.uint64(0xD6E8FEB86659FD93) + np.bitwise_xor.reduce(mix(s + np.uint64(1))) + np.uint64(len(s)))[0].astype(np.int64))


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 16 // 9))
    return np.array(out, np.int64)


EDGES = _edges()


def keys_needed(size: np.ndarray) -> np.ndarray:
    return size // 3 + 1 + spare(size)


def spare(size: np.ndarray) -> np.ndarray:
    return size // 24


def sketch_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of the sets: the keys, the set each is of, and whether it is of the set's second band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    flat = np.concatenate(sets)
    band = np.searchsorted(EDGES, sizes, "right") - 1
    keys, owners, roles = [], [], []
    for role in (0, 1):
        some = sizes > 0 if role == 0 else (sizes > 0) & (4 * sizes // 3 >= EDGES[np.minimum(band + 1, len(EDGES) - 1)])
        group = np.maximum(band + role, 0)
        parts = np.maximum(64, -(-6 * EDGES[np.minimum(group + 1, len(EDGES) - 1)] // 10)).astype(np.uint64)
        take = np.repeat(some, sizes)
        of = np.repeat(np.arange(len(sets)), sizes)[take]
        h = flat[take]
        part = ((h >> np.uint64(32)) * parts[of]) >> np.uint64(32)  # rises with h, so a set's parts come in order
        new = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(part) != 0))) if len(h) else np.zeros(0, np.int64)
        if not len(new):
            continue
        odd = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x94D049BB133111EB)), new)
        of, part = of[new][odd != 0], part[new][odd != 0]
        odd = odd[odd != 0]
        full = np.bincount(of, minlength=len(sets))
        rank = np.arange(len(of)) - (np.cumsum(full) - full)[of]
        keep = rank < keys_needed(sizes)[of]
        where = mix(group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        keys.append(mix(odd[keep] ^ mix(where[of[keep]] + part[keep])))
        owners.append(of[keep])
        thin = np.flatnonzero(some & (full < keys_needed(sizes)))
        keys.append(mix(where[thin] ^ np.uint64(0x5851F42D4C957F2D)))
        owners.append(thin)
        roles.append(np.full(len(keys[-2]) + len(thin), role, np.int8))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)


LONGS = 32
LARGE, WIDE = 1500, 256  # sets beyond LARGE shingles, which would fill that sketch, have one of WIDE numbers too


def dense(s: np.ndarray, longs: int = LONGS) -> bytes:
    """A parity sketch of ``longs`` (a power of two) numbers of 64 bits."""
    bits = (64 * longs).bit_length() - 1
    odd = np.bincount((mix(s + np.uint64(3)) >> np.uint64(64 - bits)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _entities(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_entity(s) if len(s) else None for s in sets], pa.int64()), pa.array([dense(s) if len(s) else None for s in sets], pa.binary()), pa.array([dense(s, WIDE) if len(s) > LARGE else None for s in sets], pa.binary())], ["doc_id", "digest", "n", "ent", "sketch", "wide"])

    return run


def _deal(words: int, buckets: int, most: int = 1_500_000):
    """Blocks of keys by bucket: keys in order as differences, entities, and sizes doubled with the role added; keys and sizes compressed by planes of bytes."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, ent, size, role = (np.concatenate(c) for c in zip(*held))
        bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
        order = np.lexsort((key, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        sized = (size * 2 + role).astype("<u4")
        blobs = ([planes(np.diff(key[at], prepend=np.uint64(0))) for _, at in rows], [ent[at].tobytes() for _, at in rows], [planes(sized[at]) for _, at in rows])
        columns = [pa.array([b for b, _ in rows], pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "ents", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in blocks(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)
            ents = [_entity(s) if len(s) else 0 for s in sets]
            fresh = []
            for s, e in zip(sets, ents):  # a copy in the same task adds nothing
                if len(s) and e not in seen:
                    seen.add(e)
                    fresh.append((s, e))
            if len(seen) > 200_000:
                seen.clear()
            key, of, role = sketch_keys([s for s, _ in fresh])
            held.append((key, np.array([e for _, e in fresh], np.int64)[of], np.array([len(s) for s, _ in fresh], np.int64)[of], role))
            n += len(key)
            if n > most:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


CANDIDATE = "a long, b long, key long, role int, n int"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b under uncrowded keys (key null); under crowded ones each entity b with the smallest a, and the key."""

    def one(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        key = np.concatenate([np.cumsum(unplanes(k, "<u8"), dtype=np.uint64) for k, _, _ in rows])
        ent, size = np.concatenate([np.frombuffer(e, "<i8") for _, e, _ in rows]), np.concatenate([unplanes(n, "<u4") for *_, n in rows])
        order = np.lexsort((ent, key))
        key, ent, size = key[order], ent[order], size[order]
        fresh = np.append(True, (np.diff(key) != 0) | (np.diff(ent) != 0))
        key, ent, size = key[fresh], ent[fresh], size[fresh]
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        n = np.diff(np.append(first, len(key)))
        some = np.flatnonzero((n > 1) & (n <= CROWD))
        a, b = [], []
        for gap in range(1, CROWD):
            starts = np.concatenate([first[some[n[some] > gap]][:, None] + np.arange(CROWD)]).ravel() if (n[some] > gap).any() else np.zeros(0, np.int64)
            starts = starts[starts + gap < len(key)]
            starts = starts[key[starts] == key[starts + gap]]
            starts = np.unique(starts)
            x, y = size[starts].astype(np.int64) >> 1, size[starts + gap].astype(np.int64) >> 1
            fit = DEN * np.minimum(x, y) >= NUM * np.maximum(x, y)
            a.append(ent[starts[fit]])
            b.append(ent[starts[fit] + gap])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        crowded = n > CROWD
        at = np.flatnonzero(np.repeat(crowded, n))
        leader = ent[np.repeat(first[crowded], n[crowded])]
        none = len(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[:, 0], leader])),
                pa.array(np.concatenate([pairs[:, 1], ent[at]])),
                pa.array(np.concatenate([np.zeros(none, np.int64), key[at].astype(np.int64)]), mask=np.arange(none + len(at)) < none),
                pa.array(np.concatenate([np.zeros(none, np.int32), (size[at] & 1).astype(np.int32)])),
                pa.array(np.concatenate([np.zeros(none, np.int32), (size[at] >> 1).astype(np.int32)])),
            ],
            ["a", "b", "key", "role", "n"],
        )

    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "ents", "sizes"))):
            if held and bucket != now:
                yield one(held)
                held = []
            now = bucket
            held.append(row)
    if held:
        yield one(held)


def _compare(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in blocks(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)
            a, b = [], []
            for h, e, member, s in zip(batch.column("a").to_pylist(), batch.column("ent").to_pylist(), batch.column("member").to_pylist(), sets):
                if not member:
                    hub, own = h, s
                elif h == hub:
                    same = len(np.intersect1d(own, s, assume_unique=True))
                    if DEN * same >= NUM * (len(own) + len(s) - same):
                        a.append(h)
                        b.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, words: int, block: int = 256) -> DataFrame:
    """The pairs (a, b; distinct) that are links. A hub a with many b is compared in several tasks, in blocks of its b."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("ent"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("ent"))
    rows = members.unionByName(hubs).join(texts.select("ent", "text"), "ent").repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    return rows.mapInArrow(_compare(words), "a long, b long")


def _fit(x: str, y: str) -> F.Column:
    """Sizes x and y allow a link."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and dense sketches (the wide ones, where both have them) allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(c).to_numpy() for c in ("n1", "n2"))
        keep = DEN * np.minimum(x, y) >= NUM * np.maximum(x, y)
        for one, two in (("s1", "s2"), ("w1", "w2")):
            both = np.flatnonzero(keep & np.asarray(batch.column(one).is_valid()) & np.asarray(batch.column(two).is_valid()))
            if len(both):
                l, r = (np.frombuffer(b"".join(batch.column(c).take(pa.array(both)).to_pylist()), "<u8").reshape(len(both), -1) for c in (one, two))
                keep[both] = np.bitwise_count(l ^ r).sum(1, dtype=np.int64) * (DEN + NUM) <= (x + y)[both] * (DEN - NUM)
        yield batch.select(["a", "b", "count"]).filter(pa.array(keep))


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``pairs`` (a, b, count) less those that sizes and sketches rule out; only sizes and sketches are moved for it."""
    for side, i in (("a", 1), ("b", 2)):
        pairs = pairs.join(sketches.select(F.col("ent").alias(side), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"s{i}"), F.col("wide").alias(f"w{i}")), side)
        if i == 2:
            pairs = pairs.where(_fit("n1", "n2"))
    return pairs.mapInArrow(_near, "a long, b long, count long")


def _centre(words: int):
    """Of each group's rows (g, ent, text): the ent nearest to what most of them have, and the shingles of two at least with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(g: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([s for _, s in held]), return_counts=True)
            centre = found[2 * n > len(held)]
            apart = [(len(centre) + len(s) - 2 * len(np.intersect1d(centre, s, assume_unique=True)), e) for e, s in held]
            known = n > 1
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([min(apart)[1]], pa.int64()), pa.array([np.append(found[known], n[known].astype(np.uint64)).tobytes()], pa.binary()), pa.array([len(held)], pa.int64())], [c.split()[0] for c in CENTRE.split(", ")])

        now, held = None, []
        for batch in blocks(batches, "text", 1 << 20):
            for g, e, s in zip(batch.column("g").to_pylist(), batch.column("ent").to_pylist(), shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), words)):
                if held and g != now:
                    yield one(now, held)
                    held = []
                now = g
                held.append((e, s))
        if held:
            yield one(now, held)

    return run


CENTRE = "g long, middle long, centre binary, few long"


def centres(groups: DataFrame, texts: DataFrame, words: int, few: int = 32) -> DataFrame:
    """CENTRE rows, from a few members of each group: any choice gives the same links, a good one less work."""
    order = Window.partitionBy("g").orderBy(F.xxhash64("ent", "g"), "ent")
    some = groups.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= few).select("g", "ent")
    return some.join(texts, "ent").select("g", "ent", "text").repartition("g").sortWithinPartitions("g").mapInArrow(_centre(words), CENTRE)


KEYED = "key long, ent long, root long, odd boolean, inner boolean, n long, r long, pos long"


def _residual_keys(words: int):
    """Keys of members (g, salt, member 1, ent, root, odd, data: text) by the row of their group's centre (member 0) before them.

    A residual's elements have one order in the group: those outside the centre before those of the centre that the set lacks,
    in each the rare ones (by the few members' counts) first. ``pos`` is an element's place, ``r`` the residual's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, few, centre = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(0, np.uint64)
        for batch in blocks(batches, "data", 1 << 20):
            data = batch.column("data").to_pylist()
            member, some = np.asarray(batch.column("member")).astype(bool), batch.column("root").to_pylist()
            sets = shingle_sets([d if m else None for d, m in zip(data, member)], words)
            keys, at, pos, inner, stats = [], [], [], [], np.zeros((len(sets), 2), np.int64)
            for i, (g, s) in enumerate(zip(batch.column("g").to_pylist(), sets)):
                if not member[i]:
                    known, count = np.split(np.frombuffer(data[i], np.uint64), 2)
                    count, few = count.astype(np.int64), some[i]
                    centre = 2 * count > few
                    continue
                where = np.searchsorted(known, s).clip(max=max(0, len(known) - 1))
                seen = known[where] == s if len(known) else np.zeros(len(s), bool)
                missing = centre.copy()
                missing[where[seen]] = False
                often = np.where(seen, count[where] if len(known) else 0, 1)
                outer, rare = s[2 * often <= few], often[2 * often <= few]
                lack, full = known[missing], few - count[missing]
                stats[i] = len(s), len(outer) + len(lack)
                needed = len(s) // 3 + 1
                outer, lack = outer[np.lexsort((outer, rare))][:needed], lack[np.lexsort((lack, full))][: max(0, needed - len(outer))]
                n = len(outer) + len(lack)
                thin = np.zeros(int(n < needed), np.uint64)
                group = mix(np.array([g], np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
                keys += [mix(outer ^ group), mix(lack ^ (group + np.uint64(1))), mix(thin ^ (group + np.uint64(2)))]
                at.append(np.full(n + len(thin), i))
                pos.append(np.arange(n + len(thin)))
                inner.append(pos[-1] >= len(outer))
            if not at:
                continue
            at = np.concatenate(at)
            plain = [batch.column(c).take(pa.array(at)) for c in ("ent", "root", "odd")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *plain, pa.array(np.concatenate(inner)), pa.array(stats[at, 0]), pa.array(stats[at, 1]), pa.array(np.concatenate(pos))], [c.split()[0] for c in KEYED.split(", ")])

    return run


def residual_keys(members: DataFrame, middles: DataFrame, texts: DataFrame, words: int, block: int = 1024) -> DataFrame:
    """KEYED rows for ``members`` (g, ent, root, odd) by the centres of ``middles`` (CENTRE); a large group is dealt to several tasks."""
    salts = members.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    rows = members.join(salts, "g").select("g", F.pmod(F.xxhash64("ent"), F.col("salts")).cast("int").alias("salt"), "ent", "root", "odd").join(texts, "ent")
    rows = rows.select("g", "salt", F.lit(1).alias("member"), "ent", "root", "odd", F.col("text").cast("binary").alias("data"))
    none = F.lit(None)
    heads = middles.join(salts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), none.cast("long").alias("ent"), F.col("few").alias("root"), none.cast("boolean").alias("odd"), F.col("centre").alias("data"))
    return heads.unionByName(rows).repartition("g", "salt").sortWithinPartitions("g", "salt", "member").mapInArrow(_residual_keys(words), KEYED)


def _apart_under_keys(keyed: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """From KEYED rows: pairs (a, b) of different components that may be links, and the groups (g, ent) under keys that are crowded again.

    At the first element that two residuals share, at i and j, all before it are unshared and what follows differs by its
    number at least: i + j + |(r - i) - (r' - j)| is at most the sets' symmetric difference. ``last``: crowded keys outside the
    centre give pairs too instead of groups.
    """
    count = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("ent").alias("lead"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("k > 1 and r1 != r2").select("key", "k", "lead")
    held = saved(keyed.join(count, "key"), "held")
    crowd = (F.col("k") > CROWD) & (F.lit(True) if last else F.col("inner"))
    apart = F.col("l.pos") + F.col("r.pos") + F.abs(F.col("l.r") - F.col("l.pos") - F.col("r.r") + F.col("r.pos"))
    may = (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root")) & _fit("l.n", "r.n") & (apart * (DEN + NUM) <= (F.col("l.n") + F.col("r.n")) * (DEN - NUM))
    once = (~F.col("r.odd")) | (F.col("l.ent") < F.col("r.ent"))  # of two components one at least isn't that of the group's middle
    either = held.where((F.col("k") <= CROWD) | crowd)
    pairs = either.where("odd").alias("l").join(either.alias("r"), may & once).select(F.least("l.ent", "r.ent").alias("a"), F.greatest("l.ent", "r.ent").alias("b"))
    return pairs, held.where((F.col("k") > CROWD) & ~crowd).select(F.col("lead").alias("g"), "ent").distinct()


def links(docs: DataFrame, entities: DataFrame, words: int = 5, rows_per_bucket: int = 4096, levels: int = 2) -> DataFrame:
    """root (of its component) for each entity v that is linked with another; ``docs`` has doc_id, digest and text, ``entities`` doc_id, digest, n, ent and sketches."""
    buckets = max(1, -(-entities.count() // rows_per_bucket))
    found = docs.select("text").mapInArrow(_deal(words, buckets), "bucket long, keys binary, ents binary, sizes binary")
    found = saved(found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket, CANDIDATE), "candidates")
    crowded = found.where("key is not null")
    named = found.where("a != b").groupBy("a", "b").count()

    met = found.select(F.explode(F.array("a", "b")).alias("ent")).distinct()
    sketches = entities.where("ent is not null").groupBy("ent").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.min(F.struct("doc_id", "digest")).alias("row")).select("ent", "n", "sketch", "wide", "row.doc_id", "row.digest").join(met, "ent", "left_semi")
    sketches = saved(sketches, "sketches")
    close = saved(near(named, sketches), "near")

    # The groups of those whose crowded keys outnumber what a set, or a partner of its least size, has to spare.
    counted = crowded.groupBy("b", "role").agg(F.countDistinct("key").alias("keys"), F.first("n").alias("n"))
    bound = counted.where(F.col("keys") > F.floor(F.ceil(F.col("n") * 0.75) / 24)).select("b", "role")
    groups = saved(crowded.join(bound, ["b", "role"]).select(F.col("a").alias("g"), F.col("b").alias("ent")).distinct(), "groups")
    discard(found)
    chosen = close.select(F.explode(F.array("a", "b")).alias("ent")).unionByName(groups.select("ent")).distinct()
    # One row stands for an entity; those equal in doc_id and digest have one text.
    chosen = sketches.select("ent", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).join(chosen, "ent", "left_semi")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["digest"] == F.col("_digest"))
    texts = saved(docs.join(chosen.hint("shuffle_hash"), same).select("ent", "text").dropDuplicates(["ent"]), "texts")

    # Each entity is first compared with the one that its keys name most often, and with its groups' middles.
    stars = close.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")
    middles = saved(centres(groups, texts, words), "middles")
    rays = groups.join(middles.select("g", "middle"), "g").where("ent != middle").select(F.col("middle").alias("a"), F.col("ent").alias("b")).distinct()
    rays = near(rays.withColumn("count", F.lit(1).cast("long")), sketches).select("a", "b")
    linked = saved(verify(stars.unionByName(rays).distinct(), texts, words), "links")
    roots = components(linked)
    rooted = lambda df, name: df.join(roots.select(F.col("v").alias(name), "root"), name, "left").withColumn("root", F.coalesce("root", name))

    found = []
    for level in range(levels):
        if groups.isEmpty():
            break
        if level:
            middles = saved(centres(groups, texts, words), "middles")
        main = rooted(middles.select("g", "middle"), "middle").select("g", F.col("root").alias("main"))
        members = saved(rooted(groups, "ent").join(main, "g").select("g", "ent", "root", (F.col("root") != F.col("main")).alias("odd")), "members")
        pairs, groups = _apart_under_keys(residual_keys(members, middles, texts, words), level + 1 == levels)
        found, groups = [*found, pairs], saved(groups, "groups")

    left = rooted(rooted(close.select("a", "b"), "a").withColumnRenamed("root", "x"), "b").where("x != root").select("a", "b")
    for pairs in found:
        left = left.unionByName(near(pairs.distinct().withColumn("count", F.lit(1).cast("long")), sketches).select("a", "b"))
    return components(linked.unionByName(saved(verify(left.distinct(), texts, words), "more-links")))


def _placed(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest, n and root of the rows with words, and doc_id, digest, n of those without."""
    ready(docs.sparkSession)
    docs = spread(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")))
    entities = saved(docs.mapInArrow(_entities(words), "doc_id long, digest long, n long, ent long, sketch binary, wide binary"), "entities")
    roots = links(docs, entities, words)
    full = entities.where("ent is not null").join(roots.withColumnRenamed("v", "ent"), "ent", "left")
    return full.select("doc_id", "digest", "n", F.coalesce("root", "ent").alias("root")), entities.where("ent is null").select("doc_id", "digest", "n")


def join(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of ``docs`` (doc_id, text)."""
    placed, empty = _placed(docs, words)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component: the one of the smallest doc_id stays.

    Columns of any other names are kept as they are. Rows with no doc_id stay only if the whole component has none; rows without words all stay.
    """
    placed, empty = _placed(docs, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    stay = placed.groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.digest")
    stay = saved(stay.withColumn("once", F.lit(True)).unionByName(empty.select("doc_id", "digest").distinct().withColumn("once", F.lit(False))), "stay")
    own = F.xxhash64("text")
    i, digest, single = (unused(docs, name) for name in ("_id", "_digest", "_once"))
    kept = docs.join(stay.select(F.col("doc_id").alias(i), F.col("digest").alias(digest), F.col("once").alias(single)).hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(i)) & (own == F.col(digest)))
    once = stay.where("once").select("doc_id", "digest").alias("s")
    twice = placed.groupBy("doc_id", "digest").count().where("count > 1").join(once, ["doc_id", "digest"], "left_semi")
    if not twice.isEmpty():  # rows that repeat doc_id and text: one of them
        kept = kept.where(~F.col(single)).unionByName(kept.where(F.col(single)).dropDuplicates([i, digest]))
    return kept.drop(i, digest, single)
