"""Byte-level BPE by longest matches and backtracking.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are compatible: if
merging the bytes of the two, by ranks, gives these two tokens again. So a piece is encoded left to right
with the longest token at each place that is compatible with the one before; where none is, the last token
is taken back and replaced by its next shorter prefix token. A place that has failed once is not reached
again, so the work is linear in the piece. The vocabulary's bytes, as Latin-1 characters, form one
Aho-Corasick automaton, whose single pass over a piece gives the longest token at each place. The
compatibility of two tokens is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a space stands before a character that isn't white space, the split pattern always starts a new
#: piece, so a text may be cut there and equal segments encoded once.
SEGMENT = re.compile(r"(?= \S)(?<!^)")
_ODD_SPACE = re.compile(r" (?!\S)")
#: A newline with no other white space at its sides but such a space is always a piece of its own.
_GAPS = re.compile(r"[^\S ]{2}")
#: Entries of a memo's young half; when it is full, it becomes the old half, and the old half goes.
MEMO = 400_000
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of least rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    rank = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while rank and (least := min(rank)) != _NONE:
        i = rank.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def segments(text: str) -> list[str]:
    """The text cut before every space that a visible character follows, and around lone newlines."""
    if not text:
        return []
    words, lines = text.split(), text.split("\n")
    if len(words) == text.count(" ") + len(lines) and sum(map(len, words)) + len(words) == len(text) + 1:
        # Every gap is one character, none stands at an end, and all are spaces or newlines.
        out, at = [], 0
        for line in lines:
            end = at + line.count(" ") + 1
            out.append(words[at])
            out += [f" {w}" for w in words[at + 1 : end]]
            out.append("\n")
            at = end
        out.pop()
        return out
    if _ODD_SPACE.search(text):
        return [s for s in SEGMENT.split(text) if s]
    out = []
    for k, line in enumerate([text] if _GAPS.search(text) else lines):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [f" {s}" for s in rest]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.size_of = {i: len(b) for b, i in self.ranks.items()}
        self._shorter: dict[int, int] = {}
        self._fit: dict[tuple[int, int], bool] = {}
        self._young: dict[str, tuple[str, bytes]] = {}
        self._old: dict[str, tuple[str, bytes]] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for none."""
        if (got := self._shorter.get(token)) is None:
            b = self.bytes_of[token]
            got = self._shorter[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return got

    def compatible(self, left: int, right: int) -> bool:
        if (got := self._fit.get((left, right))) is None:
            if len(self._fit) >= 4 * MEMO:
                self._fit.clear()
            got = self._fit[left, right] = merge_by_rank(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends come in order, so a longer match from a place comes later
        size_of, known = self.size_of, self._fit.get
        out: list[int] = []
        starts = [0]
        dead = bytearray(n + 1)
        token, last, at = longest[0], -1, 0
        while True:
            while token >= 0:
                end = at + size_of[token]
                if not dead[end]:
                    if last < 0 or (fits := known((last, token))) or fits is None and self.compatible(last, token):
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                starts.append(end)
                last, at, token = token, end, longest[end]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                starts.pop()
                token = self.shorter(out.pop())
                last, at = out[-1] if out else -1, starts[-1]

    def encode_segment(self, segment: str) -> tuple[str, bytes]:
        """The segment's ids: decimal, joined by spaces, and as little-endian unsigned 32-bit numbers."""
        if (got := self._old.get(segment)) is None:
            ids = [i for p in self.pieces(segment) for i in self.encode_piece(p.encode())]
            got = " ".join(map(str, ids)), np.array(ids, "<u4").tobytes()
        if len(segment) <= 64:
            if len(self._young) >= MEMO:
                self._young, self._old = {}, self._young
            self._young[segment] = got
        return got

    def encode_both(self, text: str) -> tuple[str, bytes]:
        known = self._young.get
        found = [known(s) or self.encode_segment(s) for s in segments(text)]
        return " ".join([a for a, _ in found]), b"".join([b for _, b in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_both(text)[1], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, built at its first use."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """Encodes docs.text and decodes the ids again.

    Returns a row for each row of docs (repeated rows repeat): doc_id, ids array<int> (only with ids=True),
    n_tokens, ids_sha256 (of the decimal ids, joined by one space), decoded_sha256 (of the decoded bytes).
    Null text counts as empty: no ids. An empty table gives no rows. A very long text is encoded in time
    linear in it, as is a long run without a space. The rank file is read on the executors from `path`, which every
    machine must have. Memory: one codec, its memos (at most MEMO short segments) and one text at a time.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "ids array<int>, " * ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                rows = []
                for text in part.column(1).to_pylist():
                    decimal, packed = c.encode_both(text or "")
                    got = np.frombuffer(packed, "<u4").tolist()
                    rows.append((got if ids else None, len(got), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(c.decode(got)).hexdigest()))
                lists, n, ours, back = zip(*rows, strict=True)
                columns = [part.column(0), *[pa.array(lists, pa.list_(pa.int32()))] * ids, pa.array(n, pa.int64()), pa.array(ours), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *["ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
