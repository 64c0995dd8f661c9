"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what the mask leaves.

A run is a stretch of words with smallest period q and a length of at least max(SHORTEST, TIMES * q) that no
neighbouring word extends. Its words from the q-th on repeat the ones before, so it overlaps its own shift by
q in length - q >= max(SHORTEST - q, (TIMES - 1) * q) words. The least of that over all q is OVERLAP (5, at
q = 1), and each word of a run lies in a k-gram of k = OVERLAP words that occurs twice in the document. Words
outside all repeated k-grams thus belong to no run, and the others fall into segments, each run lying in one
of them. Main and Lorentz's division finds the runs of a segment in O(n log n): runs that cross its middle
come from four Z-functions, the others lie in a half.

Python sees batches of whole texts; the mask is taken for a batch at once, and only surviving segments are
divided. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

#: A run has this many words at least, and this many times its period.
SHORTEST, TIMES = 6, 4
#: The least overlap of a run with its shift by a period. Beyond period SHORTEST the second term decides.
OVERLAP = min(max(SHORTEST - q, (TIMES - 1) * q) for q in range(1, SHORTEST + 1))
#: Words masked at once (one longer text is a batch of its own).
TOGETHER = 200_000
COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those from the start; its first is the length."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(s: list[int], low: int, mid: int, high: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the repetitions within s[low:high] that cross mid, long enough for a run, by start and end with the
    least period. For a period p, `ahead` words from mid on and `behind` words before it equal the words p
    further right (or left); together with the p words between they are the repetition."""
    left, right = s[low:mid], s[mid:high]
    back = left[::-1]
    forward = z_function(right)  # right against its own shifts
    backward = z_function(back)  # left, read backwards, against its own shifts
    into_left = z_function([*right, -1, *left, *right])[len(right) + 1 :]  # right against what starts in left
    into_right = z_function([*back, -1, *right[::-1], *back])[len(back) + 1 :]  # left, backwards, against what starts in right
    n, m = len(left), len(right)
    for p in range(1, (high - low) // TIMES + 1):
        need = max(SHORTEST, TIMES * p)
        spans = []
        if p <= m:  # words of the repetition lie p to the right of mid
            spans.append((mid - into_right[m - p], mid + p + (forward[p] if p < m else 0)))
        if p <= n:  # or to the left
            spans.append((mid - p - (backward[p] if p < n else 0), mid + into_left[n - p]))
        for a, b in spans:
            if b - a >= need and found.get((a, b), p) >= p:
                found[a, b] = p


def runs(words: list[int], low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of words[low:high] by start, then period; numbers count from the start
    of words, and words outside the range count as neighbours. Elements are numbers from 0."""
    high = len(words) if high is None else high
    found: dict[tuple[int, int], int] = {}
    parts = [(low, high)]
    while parts:
        a, b = parts.pop()
        if b - a < SHORTEST:
            continue
        mid = (a + b) // 2
        _crossing(words, a, mid, b, found)
        parts += [(a, mid), (mid, b)]
    out = []
    for (a, b), p in found.items():
        before, after = a > 0 and words[a - 1] == words[a - 1 + p], b < len(words) and words[b] == words[b - p]
        if not before and not after:  # else it's a piece of a longer one, which crosses another middle
            out.append((a, b - a, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def segments(ids: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) of ids that repeated k-grams cover, k = OVERLAP. of: each word's document, ascending;
    k-grams lie within one document and are repeated within it. Grams are compared by a 64-bit hash, so a
    chance collision can only make a segment longer."""
    k, n = OVERLAP, len(ids)
    if n < SHORTEST:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ ids[i : n - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ of[: n - k + 1].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    whole = np.flatnonzero(of[: n - k + 1] == of[k - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n - k + 1, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + k, -1)
    inside = np.cumsum(edge[:n]) > 0
    cut = np.r_[True, (inside[1:] != inside[:-1]) | (of[1:] != of[:-1])] if n else np.zeros(0, bool)
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], n]
    keep = inside[starts] & (ends - starts >= SHORTEST)
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that any run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_in(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs. Texts are masked together."""
    words = [t.split() for t in texts]
    code: dict[bytes, int] = {}
    ids = [code.setdefault(w, len(code)) for ws in words for w in ws]
    sizes = np.array([len(ws) for ws in words])
    first = np.r_[0, np.cumsum(sizes)].tolist()
    of = np.repeat(np.arange(len(words)), sizes)
    by: dict[int, list[tuple[int, int]]] = {}
    for a, b in segments(np.array(ids, np.int64), of):
        by.setdefault(int(of[a]), []).append((a, b))
    for i, ws in enumerate(words):
        own, base = [], first[i]
        if i in by:
            local = ids[base : first[i + 1]]
            own = sorted((r for a, b in by[i] for r in runs(local, a - base, b - base)), key=lambda r: (r[0], r[2]))
        yield ws, own


def batches_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > 5 * TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; on ties the smallest start, then period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse_documents(docs: DataFrame, text: str = "text", id_column: str = "doc_id", collapsed: bool = True) -> DataFrame:
    """A row for each row of docs: the id, n_runs, the run of the greatest length / period (start, length,
    period, exponent_milli; four nulls without a run), runs_sha256 over "start,length,period\\n" of each run by
    start and period, collapsed_sha256, and with `collapsed` also runs (an array of structs) and the collapsed
    text itself: the words that no run holds after its first period, joined by a space.

    Words are stretches of bytes other than space and U+0009 to U+000D. Null and empty text has no words and no
    run; its collapsed text is empty. Repeated rows repeat, ids may be null or of any type, an empty table gives
    no rows, and other columns are ignored whatever their names. A text is handled whole, in memory of a small multiple of its words.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    more = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows, lists, texts = [], [], []
                for some in batches_of([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]):
                    for words, found in find_in(some):
                        best = _best(found)
                        kept = b" ".join([w for w, k in zip(words, kept_words(len(words), found), strict=True) if k] if found else words)
                        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                        exponent = 1000 * best[1] // best[2] if best else None
                        rows.append((len(found), *(best or (None,) * 3), exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                        if collapsed:
                            lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                            texts.append(kept.decode("utf-8", "replace"))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
                names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
                if collapsed:
                    columns += [pa.array(lists, run_type), pa.array(texts, pa.string())]
                    names += ["runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    schema = f"doc_id {kind}, {COLUMNS}" + (f", {more}" if collapsed else "")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The contract's input: where h = crc32 of the decimal id is divisible by 10, each word i >= a of the text
    becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10. Such texts come
    with single spaces; others, and those of null ids, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORD_GAP + "+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        pick = lambda i: F.element_at(ws, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pick), " ")).otherwise(text)

    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)
