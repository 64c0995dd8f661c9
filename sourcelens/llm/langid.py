"""Language identification by interpolated Kneser-Ney models of character 4-grams.

Counts come from every training text. A 4-gram is four UTF-16 units packed into 64 bits, which is its hash
and its order at once. Each language's model is made in a task of its own, from all of the language's counts:
for each order a sorted array of the hashes it has with their log2 probabilities, and one of contexts with
their log2 weights, by which other 4-grams back off. The arrays are a stored table of four rows a language.
The driver sees the languages' names and the calibration only; a Python worker reads the table once. It holds
what the languages have and nothing for what they lack. A text goes to the language of least cross-entropy
per unit. The score's temperature and the limits of rejection, too, come from every training text, and each is
scored by a model that was counted without it: texts are dealt into FOLDS by a hash, and for each fold there is
a model of the others' counts. Copies of a text share a fold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import running
from .common import discard, materialize, shared_path
from .warc import store

ORDER = 4
#: Temperatures of scores that calibration chooses from.
TEMPERATURES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Units handled at once.
CHUNK = 400_000
SPACE, PAD = 32, "\0" * (ORDER - 1)
#: Rejected: cross-entropies above this quantile of the language's training texts, each scored without itself.
#: A language of fewer texts than show that quantile has a bound from their spread, one of fewer than LEAST none.
QUANTILE, LEAST = 0.995, 20
#: Training texts are scored by models of the other folds; model FOLDS is of all.
FOLDS = 4
#: Grams of one stored row.
SHARD = 250_000
UNKNOWN = "und"
#: The lowest order gives each unit a share of 2**-UNITS.
UNITS = 12


@cache
def _fold() -> np.ndarray:
    """For each UTF-16 unit: itself in lower case if it's a letter or mark (or half a pair), else a space."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for cp in range(1 << 16):
        if 0xD800 <= cp < 0xE000:
            out[cp] = cp
        elif unicodedata.category(c := chr(cp))[0] in "LM":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
    out[0] = 0
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of folded texts, padded at each start, and the number of each one's text."""
    joined = PAD + PAD.join(t.replace("\0", " ") for t in texts) + "\0"
    u = _fold()[np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), "<u2")]
    before = np.concatenate([[0], u[:-1]])
    u = u[~((u == SPACE) & ((before == SPACE) | (before == 0)))].astype(np.uint64)
    key = (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]
    text = np.cumsum(u == 0)[3:] // (ORDER - 1) - 1
    keep = u[3:] != 0
    return key[keep], text[keep]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters (one longer text is a run of its own), with their start."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, fold, gram, n over all of labelled (lang, fold, text), none null. Each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, fold), parts in held.items():
                keys, n = summed(parts)
                for k in range(0, len(keys), 50_000):
                    m = len(keys[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([fold] * m, pa.int32()), pa.array(keys[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], ["lang", "fold", "gram", "n"])
            held.clear()

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512).to_pydict()
                by: dict[tuple[str, int], list[str]] = {}
                for lang, fold, text in zip(part["lang"], part["fold"], part["text"], strict=True):
                    by.setdefault((lang, fold), []).append(text)
                for key, texts in by.items():
                    for _, some in chunks(texts):
                        parts = held.setdefault(key, [])
                        parts.append(np.unique(windows(some)[0], return_counts=True))
                        size += len(parts[-1][0])
                        if len(parts) > 8:
                            size -= sum(len(x) for x, _ in parts)
                            parts[:] = [summed(parts)]
                            size += len(parts[0][0])
                if size > 3_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return labelled.select("lang", "fold", "text").mapInArrow(run, "lang string, fold int, gram bigint, n bigint").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def folded(labelled: DataFrame) -> DataFrame:
    """lang, fold, text of labelled's rows without a null. A text's fold follows from the text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text")


class _Kneser:
    """One language's interpolated Kneser-Ney model, from sorted 4-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = {}
        for order in range(ORDER, 0, -1):
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(at, counts)
            self.levels[order] = keys, counts, discount, context, total, np.bincount(at) * discount / total
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)

    @staticmethod
    def find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(array, keys), len(array) - 1)
        return at, array[at] == keys

    def backoff(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, _, context, _, weight = self.levels[order]
        at, there = self.find(context, contexts)
        return np.where(there, weight[at], 1.0)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 2.0**-UNITS)
        own, counts, discount, context, total, weight = self.levels[order]
        c, known = self.find(context, keys >> np.uint64(16))
        k, seen = self.find(own, keys)
        direct = np.where(seen, np.maximum(counts[k] - discount, 0), 0) / total[c]
        lower = self.probability(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        return np.where(known, direct + weight[c] * lower, lower)


TABLES = "model int, lang string, level int, part int, keys binary, logs binary, contexts binary, weights binary"


def _tables(counts: pa.Table) -> pa.Table:
    """The stored rows of one language's model, from its grams and counts: for each level, runs of SHARD grams and
    contexts in order."""
    keys, n = counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(keys)
    model, lang, number = _Kneser(keys[order], n[order]), counts["lang"][0].as_py(), counts["model"][0].as_py()
    rows = []
    for order in range(ORDER, 0, -1):
        own, _, _, context, *_ = model.levels[order]
        arrays = {"keys": own, "logs": np.log2(model.probability(order, own)).astype("<f4"), "contexts": context, "weights": np.log2(model.backoff(order, context)).astype("<f4")}
        for part, k in enumerate(range(0, len(own), SHARD)):  # there are no more contexts than grams
            rows.append({"model": number, "lang": lang, "level": ORDER - order, "part": part} | {c: x[k : k + SHARD].tobytes() for c, x in arrays.items()})
    kinds = [("model", pa.int32()), ("lang", pa.string()), ("level", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "logs", "contexts", "weights"))]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


class Tables:
    """The sorted arrays of all languages, as a worker holds them."""

    def __init__(self, rows: list[dict], langs: list[str]):
        self.langs = langs
        held: dict[tuple[str, int], list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["part"]):
            held.setdefault((r["lang"], r["level"]), []).append(r)
        whole = lambda parts, c, t: np.frombuffer(b"".join(p[c] for p in parts), t)
        of = (("keys", "<u8"), ("logs", "<f4"), ("contexts", "<u8"), ("weights", "<f4"))
        # A fold's model lacks a language whose texts are all in that fold.
        self.levels = [[tuple(whole(held.get((x, level), ()), c, t) for c, t in of) for level in range(ORDER)] for x in langs]

    def logs(self, lang: int, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """log2 probabilities of sorted keys in one language."""
        if level == ORDER:
            return np.full(len(keys), -np.float32(UNITS))
        own, values, contexts, weights = self.levels[lang][level]
        if not len(own):
            return np.full(len(keys), -np.float32(UNITS))
        at, there = _Kneser.find(own, keys)
        out = values[at]
        if not there.all():
            lost = keys[~there]
            c, known = _Kneser.find(contexts, lost >> np.uint64(16))
            lower, back = np.unique(lost & np.uint64((1 << 16 * (ORDER - level - 1)) - 1), return_inverse=True)
            out[~there] = np.where(known, weights[c], np.float32(0)) + self.logs(lang, lower, level + 1)[back]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per unit of each text under each language, and the texts' units. Each distinct 4-gram of a
        run of CHUNK ones is looked up once."""
        keys, of = windows(texts)
        n = np.bincount(of, minlength=len(texts))
        bits = np.zeros((len(texts), len(self.langs)))
        for k in range(0, len(keys), CHUNK):
            some = of[k : k + CHUNK]
            own, at = np.unique(keys[k : k + CHUNK], return_inverse=True)
            first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            for i in range(len(self.langs)):
                bits[some[first], i] -= np.add.reduceat(self.logs(i, own)[at], first, dtype=np.float64)
        return bits / np.maximum(n, 1)[:, None], n


@lru_cache(maxsize=FOLDS)
def _load(path: str, langs: tuple[str, ...], number: int) -> Tables:
    """Reads one model of the stored table, in a worker."""
    fs, folder = store(f"{path}/model={number}")
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = []
    for f in sorted(files):
        with fs.open_input_file(f) as source:
            rows += pq.read_table(source).to_pylist()
    return Tables(rows, list(langs))


@dataclass
class Model:
    """Where the stored table of all languages is, and what calibration found."""

    langs: list[str]
    path: str
    temperature: float
    limit: np.ndarray

    def tables(self, number: int = FOLDS) -> Tables:
        """Of the model of all texts, or of those outside fold `number`."""
        return _load(self.path, tuple(self.langs), number)

    def confidence(self, entropies: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
        """The softmax of log likelihoods times temperature; long texts count as 1000 units."""
        odds = -(entropies - entropies.min(1, keepdims=True)) * np.minimum(n, 1000)[:, None] * temperature
        shares = np.exp2(odds)
        return shares / shares.sum(1, keepdims=True)


def train(labelled: DataFrame) -> Model | None:
    """A model of labelled (lang, text); rows with a null are left out, None if no text is left.

    Counts and calibration cover all rows, and the model keeps every 4-gram counted: discounts, totals and
    continuation counts rest on all of them. One task holds the distinct 4-grams of one language; each worker
    those of all languages, and while it calibrates FOLDS times as many.
    """
    labelled = folded(labelled)
    counts = materialize(gram_counts(labelled), "lang-grams")
    models = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))  # all others' and the whole one
    summed = counts.withColumn("model", F.explode(models)).groupBy("lang", "model", "gram").agg(F.sum("n").alias("n"))
    made = summed.groupBy("lang", "model").applyInArrow(_tables, TABLES)
    path = shared_path(labelled.sparkSession, "lang-model")
    made.write.partitionBy("model").parquet(path)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    discard(counts)
    if not langs:
        return None
    model = Model(langs, path, 0.1, np.full(len(langs), np.inf))
    calibrate(model, labelled)
    return model


def calibrate(model: Model, labelled: DataFrame) -> None:
    """Fits the temperature by log loss, and each language's rejection limit, on all texts of labelled (lang,
    fold, text), each scored by the model of the other folds.

    A text's cross-entropy under its own language and its loss at each temperature are a stored row. The
    driver sees the sums of the losses and a row for each language.
    """
    at = {x: i for i, x in enumerate(model.langs)}
    losses = [f"loss_{i}" for i in range(len(TEMPERATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048).to_pydict()
                for fold in sorted({*part["fold"]}):
                    own = [i for i, f in enumerate(part["fold"]) if f == fold]
                    for start, some in chunks([part["text"][i] for i in own]):
                        e, n = model.tables(fold).entropies(some)
                        there = np.flatnonzero(n)
                        e, n, langs = e[there], n[there], [part["lang"][own[start + i]] for i in there]
                        true = np.arange(len(there)), np.array([at[x] for x in langs], int)
                        loss = [-np.log(np.maximum(model.confidence(e, n, t)[true], 1e-9)) for t in TEMPERATURES]
                        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(e[true]), *map(pa.array, loss)], ["lang", "own", *losses])

    values = materialize(labelled.mapInArrow(run, ", ".join(["lang string", "own double", *(f"{c} double" for c in losses)])), "lang-values")
    sums = values.agg(*map(F.sum, losses)).first()
    if sums[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmin(sums))]
        known = quantiles(values, QUANTILE)
        for r in values.groupBy("lang").agg(F.avg("own").alias("mean"), F.stddev("own").alias("sd"), F.max("own").alias("most")).collect():
            texts, own = known[r["lang"]]
            model.limit[at[r["lang"]]] = limit(texts, own, r["mean"], r["sd"], r["most"])
    discard(values)


def limit(texts: int, quantile: float, mean: float, sd: float | None, most: float) -> float:
    """The cross-entropy above which a text is rejected. A new text exceeds the greatest of n with a chance of
    1 / (n + 1), so the quantile shows from n = 1 / (1 - QUANTILE) on; for fewer texts, the limit is three
    standard deviations (of a new value about the mean of n) above the greatest, and infinite below LEAST."""
    if texts < LEAST:
        return np.inf
    return quantile if texts * (1 - QUANTILE) >= 1 else most + 3 * sd * np.sqrt(1 + 1 / texts)


def quantiles(values: DataFrame, q: float) -> dict[str, tuple[int, float]]:
    """For each lang of values (lang, own): its rows, and the quantile q of own, exact, between two values in
    proportion. Equal values are counted first, and places are running counts over ranges, so that neither a
    common language nor many copies of a text are one task."""
    upto = running(values.groupBy("lang", "own").agg(F.count("*").alias("n")), ["lang"], ["own"], "upto", F.col("n"))
    sizes = values.groupBy("lang").agg(F.count("*").alias("texts"))
    place = (F.col("texts") - 1) * F.lit(q)
    low, high = (F.min(F.when(F.col("upto") > edge(place), F.col("own"))) for edge in (F.floor, F.ceil))
    # A row for each language.
    found = upto.join(F.broadcast(sizes), "lang").groupBy("lang", "texts").agg(low.alias("low"), high.alias("high"))
    return {r["lang"]: (r["texts"], r["low"] + (r["high"] - r["low"]) * ((r["texts"] - 1) * q % 1)) for r in found.collect()}


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cross_entropy (bits), rejected, for each row of docs.

    Null text, and text without a letter, is `und` with score 0, as is all text without a model; rejected
    rows keep their best language, and their score is at most 0.5. Nothing but the text is looked at. Of
    languages of equal cross-entropy the first by name is taken. Repeated rows repeat, and an empty table
    gives no rows. Long texts are scored in runs of CHUNK units.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                pred, score, cross, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), [True] * len(texts)
                for start, some in chunks(texts) if m else ():
                    e, n = m.tables().entropies(some)
                    best, sure = e.argmin(1), m.confidence(e, n, m.temperature).max(1)
                    for i, t in enumerate(some):
                        if has_letter(t):
                            pred[start + i], cross[start + i] = m.langs[best[i]], float(e[i, best[i]])
                            out[start + i] = bool(e[i, best[i]] > m.limit[best[i]])
                            score[start + i] = min(sure[i], 0.5) if out[start + i] else sure[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score), pa.array(cross, pa.float64()), pa.array(out)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def train_and_identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """Learns from the rows of docs for which learn_from holds, and identifies all rows."""
    return identify(docs, train(docs.where(learn_from).select("lang", "text")))
