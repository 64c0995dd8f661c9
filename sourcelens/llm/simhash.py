"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link when they differ in at most RADIUS = 3 bits. Half of an odd radius isn't
whole, so the odd bit is given away first: for each of four blocks of 16 bits, the block is left out and
every variant of the other 48 bits within one flip (half of the remaining radius of two) is emitted, 49
variants for each block. If two fingerprints differ in one to three bits, leave out a block that holds one
of those bits: at most two differ in the rest, so flipping one of them in the first fingerprint and the
other one in the second makes equal variants. Equal variants thus meet in one shuffle, and each meeting is
verified on the full fingerprints. The 48-bit variants keep chance meetings rare (n * n * 196 / 2**49).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, star_components

RADIUS, BLOCKS, WIDTH = 3, 4, 16
_REST = BLOCKS * WIDTH - WIDTH
#: ASCII upper case to lower case, byte by byte; other bytes stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Meetings of at most this many fingerprints are verified pair by pair; larger ones by lookups.
PAIRWISE = 2048
#: Fingerprints whose variants one task emits, and as many variants one task meets, at most on average.
EMITTED_TOGETHER = 25_000


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text in UTF-8: A-Z lower-cased, shingles of `shingle` words with repeats (fewer words:
    one shingle of all; none: 0), a bit set if it is set in over half of the shingles' XXH64."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(grams)
    for k in range(0, n, 16384):
        got = np.frombuffer(b"".join([digest(g, seed) for g in grams[k : k + 16384]]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(got, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp (the fingerprint's bits as a bigint) for each row of
    docs. Null text: no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                fps = [fingerprint(t, shingle, seed) for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def variants(fps: np.ndarray) -> Iterator[np.ndarray]:
    """For each block, the keys (block number, then the 48 other bits) of all fps within one flip."""
    for block in range(BLOCKS):
        low = np.uint64(WIDTH * block)
        rest = (fps & ((np.uint64(1) << low) - np.uint64(1))) | ((fps >> (low + np.uint64(WIDTH))) << low)
        rest |= np.uint64(block << _REST)
        yield rest
        for bit in range(_REST):
            yield rest ^ np.uint64(1 << bit)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for keys in variants(fps.view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0)], ["key", "fp"])


class Forest:
    """Components of 0..n-1 under links added in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            keep = ra != rb
            if not keep.any():
                return
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def link_meeting(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints that share a variant. fps: distinct.

    A meeting has at most 49 * 2**16 members. Small ones are verified pair by pair. In large ones a member
    is (flip, v): which bit outside the block was flipped, if any, and the block's 16 bits. Members at
    equal v or one bit apart in v always link (two flips and one bit); two bits apart if one of them has
    no flip; two or three bits apart if they have the same flip. That is at most 851 lookups a member.
    """
    n = len(fps)
    forest = Forest(n)
    if n <= PAIRWISE:
        for i in range(0, n, 256):
            a, b = np.nonzero(np.bitwise_count(fps[i : i + 256, None] ^ fps[None, i:]) <= RADIUS)
            keep = a < b
            forest.link(a[keep] + i, b[keep] + i)
    else:
        low = np.uint64(WIDTH * (key >> _REST))
        v = ((fps >> low) & np.uint64(0xFFFF)).astype(np.int64)
        rest = (fps & ((np.uint64(1) << low) - np.uint64(1))) | ((fps >> (low + np.uint64(WIDTH))) << low)
        flip = rest ^ np.uint64(key & ((1 << _REST) - 1))
        steps = {k: [sum(1 << x for x in c) for c in combinations(range(WIDTH), k)] for k in range(1, RADIUS + 1)}

        def look(members: np.ndarray, into: np.ndarray, offsets: list[int]) -> None:
            at = np.full(1 << WIDTH, -1)
            at[v[into]] = into
            for o in offsets:
                hit = at[v[members] ^ o]
                forest.link(members[hit >= 0], hit[hit >= 0])

        every = np.arange(n)
        look(every, every, [0, *steps[1]])
        for f in np.unique(flip):
            own = every[flip == f]
            look(every if f == 0 else own, own, steps[2])
            look(own, own, steps[3])
    down = np.nonzero(forest.root != np.arange(n))[0]
    return fps[down], fps[forest.root[down]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links of each meeting. A meeting that goes on in the next batch is held back."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for s, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
            x, y = link_meeting(int(keys[s]), np.unique(fps[s : s + n]))
            a.append(x)
            b.append(y)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        for k in range(0, len(pairs), 65536):
            part = np.ascontiguousarray(pairs[k : k + 65536].T).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        end = int(np.searchsorted(keys, keys[-1]))
        held_k, held_f = keys[end:], fps[end:]
        if end:
            yield from links(keys[:end], fps[:end].view(np.uint64))
    if len(held_k):
        yield from links(held_k, held_f.view(np.uint64))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links a, b between the distinct values of fps.fp (a stored table) at RADIUS or fewer bits: within each component of
    close fingerprints, enough links to connect it (no link is lost to a component)."""
    # Eight bytes a row here, 196 rows each after: AQE mustn't join these partitions by their size, so their
    # number follows from the rows of the stored table.
    spread = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // EMITTED_TOGETHER))
    keyed = fps.select("fp").distinct().repartition(spread).mapInArrow(_emit, "key bigint, fp bigint")
    met = keyed.repartition(spread, "key").sortWithinPartitions("key")
    return met.mapInArrow(_verify, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text; other columns are ignored).

    Returns doc_id, text_hash and fp (bigint), fingerprint string (16 hex digits), component_id (the
    smallest doc_id reachable over links), component (the smallest fp, which names the class always). One row for each input row; repeated rows repeat; an empty table gives no rows;
    null or blank text has fingerprint 0, linked like any other; a null doc_id is kept, belongs to its
    class, and names it only if no row of the class has an id (component_id null).
    Exact copies collapse to one fingerprint before anything is emitted, so a hot text costs one row.
    """
    prints = materialize(with_fingerprints(docs, shingle, seed), "simhash")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = star_components(fingerprint_links(prints), "simhash-links")
    rooted = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("component"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each near-duplicate class: that of the smallest doc_id (null ids count as
    greatest), of its texts the one of smallest hash, and of equal rows any one. Columns stay."""
    key, place = free_name(docs, "key", "place")
    name = lambda h: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(h))
    best = near_duplicates(docs.select("doc_id", "text")).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    kept = materialize(best.select("best.doc_id", "best.text_hash").select(name(F.col("text_hash")).alias(key)), "simhash-kept")
    rows = docs.withColumn(key, name(F.xxhash64(F.col("text").cast("string")))).join(kept, key, "left_semi")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(place) == 1).select(docs.columns)
