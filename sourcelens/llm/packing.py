"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most CAPACITY tokens. Only the histogram of piece lengths, at most CAPACITY
rows, reaches the driver. Best-fit decreasing runs there over counts: sequences with the same free space
that were filled alike form one run of sequence numbers, and a length is placed into a whole run at a time.
Each run that a length fills keeps less than half of its free space, and each length splits one run into
three at most, so the plan has at most 11 * 3 * CAPACITY rows, however many documents there are. Pieces
then take their planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import segments
from .common import materialize

CAPACITY = 2048
#: Pieces of one length that one task ranks, about; longer runs of equal lengths are salted.
RANKED_TOGETHER = 20_000
#: Bytes of the young half of the tokenizer's memo, about; when it is full, it becomes the old half. A segment
#: takes SEGMENT_BYTES (a string, its ids and their place in the table), and more if it is long.
MEMO_BYTES, SEGMENT_BYTES = 90_000_000, 190
SIGNS = ".,;:!?*$%&#|"
SLOTS = "length bigint, low bigint, high bigint, base bigint, per bigint, place bigint"


class SegmentTokenizer:
    """A tokenizers file with a memo of segments. The byte-level split always starts a new piece at a
    space before a visible character, so segments encode alone as they do in the text; a text that holds
    the string of an added token is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            size[i] = len(token)  # byte-level tokens have a character for each byte
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, parts: list[str]) -> list[bytes]:
        """The ids of each segment. Signs at the end of a word are pieces of their own, so word and signs
        are encoded apart, each once."""
        apart = {}
        for s in [s for s in parts if s[-1] in SIGNS]:
            if (b := s.rstrip(SIGNS)) and b[-1].isalnum():
                apart[s] = b, s[len(b) :]
        need = set(parts).difference(apart).union(chain.from_iterable(apart.values()))
        known, young = {}, self.young
        fresh = list(need.difference(young))
        for s in need.difference(fresh):
            known[s] = young[s]
        spaced = [s for s in fresh if s[0] == " "]
        bare = [s for s in fresh if s[0] != " " and s.split() == [s]]
        rest = [s for s in fresh if s[0] != " " and s.split() != [s]]
        known |= zip(rest, self.packed(rest), strict=True)
        # Others are encoded end to end, as each starts a new piece or stands between lone newlines; the
        # bytes that the ids stand for show where each one ends.
        for some, gap in ((spaced, ""), (bare, "\n")):
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                ids = np.frombuffer(self.packed([gap.join(part)])[0], "<u4")
                ends = np.cumsum([len(s.encode()) + len(gap) for s in part]) - len(gap)
                at = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
                data = ids.tobytes()
                starts = [0, *(4 * (at[:-1] + len(gap))).tolist()]
                known |= {s: data[a:b] for s, a, b in zip(part, starts, (4 * at).tolist(), strict=True)}
        return [known[s] if s not in apart else known[apart[s][0]] + known[apart[s][1]] for s in parts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [None if any(a in t for a in self.added) else segments(t) for t in texts]
        whole = [t for t, c in zip(texts, cut, strict=True) if c is None]
        long = dict(zip(whole, self.packed(whole), strict=True)) if whole else {}
        if self.young_bytes >= MEMO_BYTES:
            self.young, self.old, self.young_bytes = {}, self.young, 0
        young, old, new = self.young, self.old, set()
        for c in cut:
            new.update(c or ())
        new = new.difference(young)  # looks the new ones up, however large the memo
        fresh = list(new.difference(old))
        for s in new.difference(fresh):
            young[s] = old[s]
        young.update(zip(fresh, self.alone(fresh), strict=True))
        self.young_bytes += SEGMENT_BYTES * len(new) + sum(map(len, new))
        out = [long[t] if c is None else b"".join(map(young.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        for s in fresh:
            if len(s) > 64:
                del young[s]
        return out


@lru_cache(maxsize=2)
def segment_tokenizer(path: str) -> SegmentTokenizer:
    return SegmentTokenizer(path)


def tokenize_pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Cuts documents into pieces: ids of the text without special tokens, then end_id. A document of more
    than `capacity` ids is cut into pieces of that many, the first of which may be shorter.

    Returns doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)
    and, with ids=True, ids array<bigint>. Null text counts as empty and gives one piece of one id.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = segment_tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                of, piece, start, length, crc, lists = [], [], [], [], [], []
                for row, data in enumerate(t.ids([x or "" for x in part.column(1).to_pylist()])):
                    data += end
                    n = len(data) // 4
                    first = n % capacity or capacity if n > capacity else n
                    for i, (lo, hi) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n + 1, capacity)], strict=True)):
                        of.append(row), piece.append(i), start.append(lo), length.append(hi - lo)
                        crc.append(zlib.crc32(data[4 * lo : 4 * hi]))
                        lists.append(np.frombuffer(data[4 * lo : 4 * hi], "<u4") if ids else None)
                columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                columns += [pa.array(lists, pa.list_(pa.int64()))] * ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Returns rows (length, low, high, base, per, place): pieces of this
    length with rank r in [low, high) take sequence base + (r - low) // per, at
    place + (r - low) % per * length."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs (first sequence, how many)
    spaces = bytearray(capacity + 1)
    out, sequences = [], 0

    def put(space: int, base: int, n: int) -> None:
        if space and n:
            free[space].append((base, n))
            spaces[space] = 1

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        low, left = 0, histogram[length]
        while left:
            space = spaces.find(1, length)
            if space < 0:
                space, per = capacity, capacity // length
                base, n = sequences, -(-left // per)
                sequences += n
            else:
                per = space // length
                base, n = free[space].pop()
                spaces[space] = bool(free[space])
            full = min(n, left // per)
            some = left - full * per if full < n and left < n * per else 0
            for first, count, each in ((base, full, per), (base + full, 1 if some else 0, some)):
                if count:
                    out.append((length, low, low + count * each, first, each, capacity - space))
                    put(space - each * length, first, count)
                    low, left = low + count * each, left - count * each
            used = full + bool(some)
            put(space, base + used, n - used)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and other columns). `pieces` is read
    three times, so it should be a stored table. Every piece gets a slot; offsets in a sequence are
    gapless from 0. Empty input gives no rows. Equal rows take different slots."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(x, -(-n // RANKED_TOGETHER)) for x, n in histogram.items()], "length bigint, salts bigint")
    slots = spark.createDataFrame(plan_slots(histogram, capacity), SLOTS)
    # Both are bounded by the capacity, not by the data.
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    k = F.col("rank") - F.col("low")
    placed = ranked.alias("p").join(F.broadcast(slots.alias("s")), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*(F.col(f"p.{c}") for c in pieces.columns), (F.col("base") + F.expr("(rank - low) div per")).alias("sequence_id"), (F.col("place") + F.pmod(k, F.col("per")) * F.col("p.length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """tokenize_pieces and pack of docs (doc_id, text; other columns are ignored)."""
    return pack(materialize(tokenize_pieces(docs, path, capacity=capacity), "pieces"), capacity)
