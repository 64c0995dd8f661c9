"""MinHash near-duplicates with HyperMinHash registers.

A document's set is its distinct shingles, each a 64-bit hash. The hash's first bits choose one of BUCKETS
buckets; of the rest, the least value in a bucket is kept as the number of its leading zeros and the MANTISSA
bits after its first one: 16 bits a bucket. Two sets agree in a bucket where the least value is of a shared
shingle, so agreement over buckets estimates the Jaccard similarity, less the chance agreement of such
registers, which follows from the sets' sizes.

1. Bands: ROWS registers each are hashed; sets that agree in a band meet. Empty registers are first filled from
   others in a fixed random order (densification), so small sets meet as likely as large ones: a pair of
   similarity 0.8 misses all 64 bands with a chance of 8 in a million.
2. In each band the least set is the pivot of the others: as many pairs as members. Pairs whose sizes or whose
   corrected estimate (six standard deviations below the threshold) rule a link out go; the rest is verified on
   full sets, and links give components.
3. What may still be missed are links within a band between members of different components. Only bands that
   hold such members go on, cut into blocks, and two blocks are a task of bounded size: there, pairs of
   different components that the estimate can't rule out are verified on full sets, likeliest first, until the
   components are connected. Links come out, not pairs, at most one for each two components of a task.

Equal sets are one set before anything is emitted. No pair of a band is left out and no band is cut.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, discard, materialize, star_components

SHINGLE, PERCENT = 2, 80
#: Buckets are 2 ** BITS; a band is ROWS registers.
BITS, MANTISSA, ROWS = 9, 10, 8
BUCKETS = 1 << BITS
#: Members of a block (a task holds two, some megabytes; a set is copied once for each block of its band), and standard deviations that an estimate is trusted within.
BLOCK, SIGMAS = 1024, 6.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept for a worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8: A-Z lower-cased, words between space and U+0009 to
    U+000D. With fewer words than a shingle, the whole sequence is one; without words there is none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    with np.errstate(over="ignore"):
        # The number of words is hashed too: a short sequence is no shingle of full length.
        out = np.full(len(h) - size + 1, size, np.uint64) * _K[3]
        for i in range(size):
            out = _mix((out + h[i : len(h) - size + 1 + i]) * _K[0])
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: leading zeros plus one, then MANTISSA bits; 0 for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the least of each bucket
        value = (shingles[first] << np.uint64(BITS)) >> np.uint64(11)  # 53 bits, which a double holds
        zeros = 53 - np.frexp(value.astype(np.float64))[1].astype(np.int64)
        mantissa = ((value << (zeros + 11).astype(np.uint64)) >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


_PROBES = np.argsort(_mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * _K[0]).reshape(BUCKETS, BUCKETS), axis=1)


def densified(regs: np.ndarray) -> np.ndarray:
    """regs (sets by buckets) with each empty register filled by the first filled one in the bucket's own order."""
    out = regs.copy()
    row, col = np.nonzero(regs == 0)
    some = (regs != 0).any(axis=1)
    row, col = row[some[row]], col[some[row]]
    for t in range(BUCKETS):
        if not len(row):
            break
        got = regs[row, _PROBES[col, t]]
        out[row, col] = got
        left = got == 0
        row, col = row[left], col[left]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set and band of ROWS registers (sets by bands)."""
    dense = densified(regs).reshape(len(regs), -1, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, dense.shape[1] + 1, dtype=np.uint64) * _K[3], dense.shape[:2]).copy()
        for i in range(ROWS):
            key = _mix((key + dense[:, :, i]) * _K[0])
    return key


def chance(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The chance that a register of two sets of these sizes agrees though its least values differ: both have the
    same leading zeros and mantissa."""
    out = np.zeros(np.broadcast(n1, n2).shape)
    for zeros in range(54):
        p = [np.exp(-n / BUCKETS * 2.0 ** -(zeros + 1)) - np.exp(-n / BUCKETS * 2.0**-zeros) for n in (n1, n2)]
        out += p[0] * p[1] / (1 << MANTISSA)
    return out


def may_link(same: np.ndarray, filled: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The corrected estimate from `same` equal registers of `filled` that either set has, and whether it leaves a
    link possible. The buckets' least shingles are a sample of the union without replacement, so small sets,
    which have a bucket for nearly each shingle, are estimated nearly exactly."""
    n1, n2 = n1.astype(float), n2.astype(float)
    lucky, at = chance(n1, n2), percent / 100
    estimate = (same / np.maximum(filled, 1) - lucky) / (1 - lucky)
    union = np.maximum((n1 + n2) / (1 + at), filled)
    spread = np.sqrt(at * (1 - at) / np.maximum(filled, 1) * (1 - filled / union))
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return estimate, fits & (estimate >= at - SIGMAS * spread - 1.5 / np.maximum(filled, 1))


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((a == b) & (a != 0)).sum(-1), ((a != 0) | (b != 0)).sum(-1)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BUCKETS)


def with_registers(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key (binary), set_key (binary; null for a set without shingles), n, regs of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingle_set(t, shingle) for t in part.column(2).cast(pa.binary()).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).astype("<u2").tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set_key", "n", "regs"])

    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, text_key binary, set_key binary, n bigint, regs binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            keys = band_keys(_regs(part.column(1)))
            for j in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, j].view(np.int64)), part.column(0)], ["band", "sid"])


def _estimate(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same, filled = agreement(_regs(b["regs_a"]), _regs(b["regs_b"]))
                estimate, ok = may_link(same, filled, b["n_a"].to_numpy(), b["n_b"].to_numpy(), percent)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep), pa.array(estimate[ok])], ["a", "b", "estimate"])

    return run


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that may link, with the estimate. sets: sid, n, regs."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimate(percent), "a bigint, b bigint, estimate double")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets link. texts: sid, text of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(sid: int, text: bytes) -> np.ndarray:
            if sid not in kept:
                kept[sid] = shingle_set(text, shingle)
                while len(kept) > 64:
                    kept.popitem(last=False)
            return kept[sid]

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = []
                for x, y, s, t in zip(part["a"].to_pylist(), part["b"].to_pylist(), part["text_a"].cast(pa.binary()).to_pylist(), part["text_b"].cast(pa.binary()).to_pylist(), strict=True):
                    one, two = of(x, s), of(y, t)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        out.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    side = lambda x: texts.select(F.col("sid").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _joined(percent: int, shingle: int):  # noqa: ANN202
    """For two blocks of one band: links that connect sets of different components, found on the full sets.

    A pair that meets in several bands is looked at in the first of them only, and not at all once its
    components are connected here, so what comes out is a forest. Sets are made when an estimate asks for them."""

    def run(table: pa.Table) -> pa.Table:
        side, sid, root, n = (table[c].to_numpy() for c in ("side", "sid", "comp", "n"))
        regs, texts, band = _regs(table["regs"].combine_chunks()), table["text"], np.uint64(table["band"][0].as_py() % (1 << 64))
        keys, root, sets, found = band_keys(regs), root.copy(), {}, []
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), shingle)
            return sets[i]

        for i in left.tolist():
            to = right[(root[right] != root[i]) & ((side[i] != 0) | (sid[right] > sid[i]))]
            to = to[100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i])]
            if not len(to):
                continue
            first = (keys[to] == keys[i]).argmax(axis=1)
            to = to[keys[i, first] == band]
            estimate, ok = may_link(*agreement(regs[i], regs[to]), n[i : i + 1], n[to], percent)
            for j in to[ok][np.argsort(-estimate[ok], kind="stable")].tolist():
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    found.append((int(sid[i]), int(sid[j])))
                    root[root == root[j]] = root[i]
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _across(members: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links a, b between members (band, sid, comp, size) of one band but different components. A band is cut
    into blocks by a hash of the set, and each two blocks are a task."""
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("sid"), blocks).cast("int")})
    # A block meets itself (side 0), and each other one once (-1: the lower one, 1: the upper one).
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(o == F.col("block"), 0).when(F.col("block") < o, -1).otherwise(1).alias("side")))
    dealt = cut.select("band", "sid", "comp", F.explode(meets).alias("m")).select("band", "sid", "comp", "m.*")
    rows = dealt.join(sets.select("sid", "n", "regs"), "sid").join(texts.select("sid", F.col("text").cast("binary").alias("text")), "sid")
    # As many tasks as asked for: few bytes take long here, so AQE mustn't join partitions by their size.
    return rows.repartition(spread, "band", "i", "j").groupBy("band", "i", "j").applyInArrow(_joined(percent, shingle), "a bigint, b bigint")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """sid, comp of nodes (sid) under links (a, b)."""
    roots = star_components(links, "minhash-components")
    return nodes.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("comp"))


def components(sets: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """sid, comp (the least sid of the component) of sets (sid, text_key, n, regs; a stored table of distinct sets,
    none empty). docs (doc_id, text) has a text for each text_key."""
    emitted = sets.select("sid", "regs").mapInArrow(_emit, "band bigint, sid bigint")
    pivots = emitted.groupBy("band").agg(F.min("sid").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    met = materialize(emitted.join(pivots, "band"), "minhash-met")
    own = materialize(sets.join(met.select("sid").distinct(), "sid", "left_semi"), "minhash-sets")
    pairs = met.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    likely = materialize(_estimated(pairs, own, percent), "minhash-pairs")
    # Copies of a text are one row before they are shuffled.
    known = _keyed(docs.select("doc_id", "text")).groupBy("text_key").agg(F.first("text").alias("text"))
    texts = materialize(own.select("sid", "text_key").join(known, "text_key").select("sid", "text"), "minhash-texts")
    named = materialize(_named(own.select("sid"), _verified(likely, texts, shingle, percent)), "minhash-named")

    # Bands whose members are not yet of one component; of two members, the pair has been looked at.
    open_ = met.where("size > 2").join(named, "sid")
    mixed = open_.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    more = materialize(_across(open_.join(mixed, "band").select("band", "sid", "comp", "size"), own, texts, shingle, percent), "minhash-more")
    # Components are the nodes now, so there are few.
    comp = lambda x: named.select(F.col("sid").alias(x), F.col("comp").alias(f"comp_{x}"))
    between = more.join(comp("a"), "a").join(comp("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    least = _named(named.select(F.col("comp").alias("sid")).distinct(), between)
    final = materialize(named.join(least.select(F.col("sid").alias("comp"), F.col("comp").alias("least")), "comp").select("sid", F.col("least").alias("comp")), "minhash-final")
    for old in (met, own, likely, texts, named, more):
        discard(old)
    return sets.select("sid").join(final, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes of docs (doc_id bigint, text; other columns are ignored).

    Texts link when 100 * shared >= percent * all of their distinct shingles. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable over links, itself included), kept (doc_id = component_id), a
    row for each input row. Null and blank text has no shingles and links with nothing, its copies included. A
    null doc_id takes part in its class, and its component_id is null only if no row of the class has an id;
    it is kept then. Repeated rows repeat, and an empty table gives no rows.
    """
    prints = materialize(with_registers(docs, shingle), "minhash")
    some = prints.where("n > 0")
    one = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("text_key", "n", "regs")).alias("x"))
    sets = materialize(one.select(F.monotonically_increasing_id().alias("sid"), "set_key", "doc_id", "x.*"), "minhash-distinct")
    named = components(sets, docs, shingle, percent)
    classes = sets.select("sid", "set_key", "doc_id").join(named, "sid")
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = classes.join(least, "comp").select("set_key", "component_id")
    rows = prints.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(of_set, "set_key", "left")
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))



_WORDS_SQL = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_GAP}+'), lambda x: x <> '')"
#: The same in DuckDB's SQL, for unique ids.
SQL = f"""
with recursive d as (select doc_id, {_WORDS_SQL} w from documents),
s as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from d),
k as (select doc_id, len(s)::bigint n, list_sort(s) s from s),
sets as (select s, n, min(doc_id) m from k where n > 0 group by s, n), e as (select m, n, unnest(s) g from sets),
p as (select a.m a, b.m b from e a join e b on a.g = b.g and a.m < b.m and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) group by a.m, b.m, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
links as (select a, b from p union all select b, a from p),
reach as (select m a, m r from sets union select b, r from reach join links using (a)),
low as (select a m, min(r) r from reach group by a)
select doc_id, k.n n_shingles, coalesce(r, doc_id) component_id, coalesce(r, doc_id) = doc_id kept from k left join sets on k.s = sets.s and k.n > 0 left join low using (m)
"""
