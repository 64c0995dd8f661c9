"""The term index as tables: postings, document lengths and gram sketches, kept up to date by differences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import order

#: Limits that a caller may ask for, and the highest frequency kept.
MAX_TERMS, MAX_GRAMS, MAX_ENTRIES, MAX_TF = 32_768, 16_384, 4_000_000, 65_535


def document_lengths(corpus: DataFrame) -> DataFrame:
    """path, dl: tokens, at least 1."""
    return corpus.select("path", F.greatest(F.size(T.tokens(F.col("text"))), F.lit(1)).cast("bigint").alias("dl"))


#: Tokens, and bytes of text, that a task has as arrays of numbers at a time (one document at least).
TOKENS_TOGETHER, BYTES_TOGETHER = 500_000, 1 << 20
_PARTS = re.compile("[_-]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: What a token that can be split holds.
_SPLIT = "[_-]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
#: Characters of grams, by their number from 1 on; 0 is any other byte.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_-"
_SIGN = np.zeros(256, np.int32)
for _i, _c in enumerate(_SIGNS):
    _SIGN[[ord(_c), ord(_c.upper())]] = _i + 1
_N = len(_SIGNS) + 1


def _parted(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes make `most` at most, or of one row."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct terms of each list of tokens: number of the list (ascending), number of the term, occurrences;
    and the terms. Tokens are numbered first, so only distinct ones are split (as T.fragments does)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    tokens, n = coded.dictionary, len(coded.dictionary)
    odd = np.flatnonzero(pc.match_substring_regex(tokens, _SPLIT).to_numpy(zero_copy_only=False))
    parts = [[x for x in _PARTS.split(t) if len(x.encode()) >= T.MIN_BYTES] for t in tokens.take(pa.array(odd)).to_pylist()]
    numbered = pc.ascii_lower(pa.concat_arrays([tokens, pa.array([x for p in parts for x in p], pa.string())])).dictionary_encode()
    # The terms of a token stand together: itself, twice if it can't be split, then its fragments.
    of = np.r_[np.arange(n), np.repeat(odd, [len(p) for p in parts])].astype(np.int64)
    times = np.ones(len(of), np.int64)
    times[:n] = 2
    times[odd] = 1
    order = np.argsort(of, kind="stable")
    term, times, width = numbered.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), times[order], np.bincount(of, minlength=n)
    start = np.cumsum(width) - width
    token = coded.indices.to_numpy(zero_copy_only=False)
    each = width[token]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - start[token], each)
    m = max(1, len(numbered.dictionary))
    key = np.repeat(np.repeat(np.arange(len(lists), dtype=np.int64), sizes) * m, each) + term[at]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first] // m, key[first] % m, np.add.reduceat(times[at][order], first) if len(key) else key, numbered.dictionary


@lru_cache(maxsize=1)
def _gram_names() -> pa.Array:
    """Pairs and triples of signs at the places where `_grams_of` puts them; "" where no gram is."""
    signs = ["", *_SIGNS]
    pairs = [a + b if a and b else "" for a in signs for b in signs]
    return pa.array([*pairs, *(p + c if p and c else "" for p in pairs for c in signs)], pa.string())


def _grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs and triples of signs (T.ascii_grams) of each text: its number (ascending), place in `_gram_names`."""
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    data = pa.concat_arrays([data])  # its own buffers, from the first byte on
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if data.buffers()[2] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    sign, total = _SIGN[raw], len(_gram_names())
    seen = np.zeros(len(data) * total, bool)
    if len(sign) > 1:
        row = np.repeat(np.arange(len(data), dtype=np.int64) * total, np.diff(ends))
        pair = (sign[:-1] > 0) & (sign[1:] > 0) & (row[:-1] == row[1:])
        code = sign[:-1] * _N + sign[1:]
        at = np.flatnonzero(pair)
        seen[row[at] + code[at]] = True
        at = np.flatnonzero(pair[:-1] & pair[1:])
        seen[row[at] + _N * _N + code[at] * _N + sign[at + 2]] = True
    found = np.flatnonzero(seen)
    return found // total, found % total


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n rows of the values that have its number."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def entries(corpus: DataFrame, terms: bool = True, grams: bool = True) -> DataFrame:
    """The corpus without its texts, each document with its distinct terms (array of term, tf) and its grams (array),
    as asked for, and dl. A document is one row and needs no other one, so nothing is shuffled: Spark finds the tokens,
    and a task counts those of some documents at a time as arrays of numbers. Null text gives empty arrays."""
    text, own = F.col("text"), [c for c in corpus.columns if c != "text"]
    given = corpus.select(*own, *([] if terms else [F.greatest(F.size(T.tokens(text)), F.lit(1)).cast("bigint").alias("dl")]), *([T.tokens(text).alias("_tokens")] if terms else []), *([text, F.when(F.octet_length(text) > F.char_length(text), T.scalars(text)).alias("_odd")] if grams else []))
    more = ["terms array<struct<term:string,tf:bigint>>"] * terms + ["grams array<string>"] * grams
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema if f.name != "text"), "dl bigint", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if terms:
                b = b.append_column("dl", pc.max_element_wise(pc.list_value_length(b["_tokens"]).cast(pa.int64()), 1))  # noqa: PLW2901
            # Flags of grams are some 60 KB a document, so a short one counts as 16 KB.
            weight = pc.max_element_wise(pc.fill_null(pc.binary_length(b["text"]), 0).cast(pa.int64()), 16_384) if grams else b["dl"]
            for lo, hi in _parted(weight.to_numpy(zero_copy_only=False), BYTES_TOGETHER if grams else TOKENS_TOGETHER):
                part, made = b.slice(lo, hi - lo), []
                if terms:
                    row, term, tf, names = _counted(part["_tokens"])
                    values = [names.take(pa.array(term)), pa.array(np.minimum(tf, MAX_TF), pa.int64())]
                    made.append(_lists(row, len(part), pa.StructArray.from_arrays(values, ["term", "tf"])))
                if grams:
                    row, gram = _grams_of(part["text"])
                    names, odd = _gram_names().take(pa.array(gram)), pa.array(part["_odd"])
                    where = np.r_[row, pc.list_parent_indices(odd).to_numpy(zero_copy_only=False)]
                    order = np.argsort(where, kind="stable")
                    made.append(_lists(where[order], len(part), pa.concat_arrays([names, pc.list_flatten(odd).cast(pa.string())]).take(pa.array(order))))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in (*own, "dl")), *made], [*own, "dl", *["terms"] * terms, *["grams"] * grams])

    return given.mapInArrow(run, schema)


def postings(corpus: DataFrame, max_terms: int | None = None) -> DataFrame:
    """path, term, tf, truncated. A token counts as itself and as each of its fragments, so one that can't be
    split counts twice. All terms are kept; with max_terms, a document keeps its terms of smallest spelling,
    and the rows of one that lost any say truncated. A path is one document."""
    return posted(limited(entries(corpus.select("path", "text"), grams=False), max_terms))


def limited(rows: DataFrame, max_terms: int | None) -> DataFrame:
    """Rows of `entries` with terms_cut; with max_terms, no document has more terms, and those of smallest spelling stay."""
    if max_terms is None:
        return rows.withColumn("terms_cut", F.lit(False))
    return rows.withColumns({"terms_cut": F.size("terms") > max_terms, "terms": F.slice(F.array_sort("terms"), 1, max_terms)})


def posted(rows: DataFrame) -> DataFrame:
    """path, term, tf, truncated of rows of `limited`."""
    return rows.select("path", F.explode("terms").alias("x"), F.col("terms_cut").alias("truncated")).select("path", "x.term", "x.tf", "truncated")


def first_grams(corpus: DataFrame, max_grams: int) -> DataFrame:
    """path, grams, grams_cut: the first max_grams of each document."""
    text = F.col("text")
    every = corpus.select("path", F.array_distinct(F.concat(T.ascii_grams(text), T.scalars(text))).alias("grams"))
    return every.select("path", F.slice("grams", 1, max_grams).alias("grams"), (F.size("grams") > max_grams).alias("grams_cut"))


def gram_sketch(corpus: DataFrame, max_grams: int | None = None) -> DataFrame:
    """path, gram, truncated: ASCII pairs and triples of token runs, and the characters of other tokens. All
    are kept; with max_grams, the first ones, and the rows of a document that lost any say truncated."""
    if max_grams is None:
        rows = entries(corpus.select("path", "text"), terms=False).withColumn("grams_cut", F.lit(False))
    else:
        rows = first_grams(corpus, max_grams)
    return rows.select("path", F.explode("grams").alias("gram"), F.col("grams_cut").alias("truncated"))


def gram_candidates(sketch: DataFrame, term: str) -> DataFrame:
    """path of documents whose sketch holds every gram of the term: a superset of those that contain it, but
    for truncated documents. Only the wanted grams are shuffled."""
    wanted = T.query_grams(term)
    held = sketch.where(F.col("gram").isin(wanted)).groupBy("path").agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") == len(wanted)).select("path")


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """term, df (documents that hold it), total (occurrences). A document is one row, so its terms are made
    distinct within it; a task counts those of many documents as arrays of numbers, and sends on each term once
    for them. The only shuffle is by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b["ts"]), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parted(sizes, TOKENS_TOGETHER):
                _, term, tf, names = _counted(b["ts"].slice(lo, hi - lo))
                total = np.bincount(term, tf, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names)), pa.int64()), pa.array(total)], ["term", "df", "total"])

    each = corpus.select(T.tokens(F.col("text")).alias("ts")).mapInArrow(run, "term string, df bigint, total bigint")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (1.0 for an empty corpus)."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def indexed_frequency(post: DataFrame, sketch: DataFrame, terms: list[str]) -> DataFrame:
    """path, term, tf for the query's terms: the exact frequency, or 1 where only the sketch holds all
    grams of the term."""
    exact = post.where(F.col("term").isin(terms)).select("path", "term", "tf")
    spark = post.sparkSession
    grams = spark.createDataFrame([(t, g) for t in terms for g in T.query_grams(t)], "term string, gram string")
    need = spark.createDataFrame([(t, len(T.query_grams(t))) for t in terms], "term string, need int")
    # Both hold the query's own grams only.
    held = sketch.join(F.broadcast(grams), "gram").groupBy("path", "term").agg(F.count_distinct("gram").alias("n"))
    loose = held.join(F.broadcast(need), "term").where("n = need").select("path", "term", F.lit(1).cast("bigint").alias("tf"))
    return exact.unionByName(loose).groupBy("path", "term").agg(F.max("tf").alias("tf"))


def reconcile(files: DataFrame, index: DataFrame, stamp: list[str], complete: Column | None = None) -> DataFrame:
    """path, state: what the index must do. missing and changed files are read, current ones kept, and
    deleted ones dropped, though only if the discovery that `complete` tells of was complete."""
    f = files.select("path", F.struct(*stamp).alias("new"))
    i = index.select(F.col("path").alias("path_"), F.struct(*stamp).alias("old"))
    j = f.join(i, F.col("path") == F.col("path_"), "full_outer")
    gone = F.when(F.lit(True) if complete is None else complete, "deleted").otherwise("current")
    state = F.when(F.col("path_").isNull(), "missing").when(F.col("path").isNull(), gone).when(F.col("new").eqNullSafe(F.col("old")), "current").otherwise("changed")
    return j.select(F.coalesce("path", "path_").alias("path"), state.alias("state"))


def apply_delta(index: DataFrame, states: DataFrame, fresh: DataFrame) -> DataFrame:
    """index rows of current files, and fresh rows for missing and changed ones."""
    keep = index.join(states.where("state = 'current'").select("path"), "path", "left_semi")
    return keep.unionByName(fresh.join(states.where("state in ('missing', 'changed')").select("path"), "path", "left_semi"))


def saturated(entries: DataFrame, cap: int = MAX_ENTRIES) -> DataFrame:
    """entries (seq, path, n) with total and kept: documents join the index in order of seq until the
    running total would pass the cap."""
    total = order.running(entries, [], ["seq"], "total", F.col("n"))
    return total.withColumn("kept", F.col("total") <= cap)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)
