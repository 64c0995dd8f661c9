"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees over document statistics give paths; each path is a conjunctive rule. A logistic regression
with a lasso penalty weights the rules and drops most. What is left is one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import total
from .quality_rules import GAPS, SYMBOLS

#: About so many labelled documents at most are learnt from, chosen by hash.
TRAINING = 10_000
TREES, DEPTH, CUTS, MIN_LEAF = 40, 3, 15, 10
#: Lasso strengths tried; the one of least loss on a fifth of the training documents is used.
STRENGTHS = (0.0003, 0.001, 0.003, 0.01)
THRESHOLD = 0.3
FEATURES = ("log_chars", "log_words", "word_len", "upper", "bang", "pipe", "symbol", "digit", "stop", "comma", "distinct", "longest_line", "dup_line", "words_a_line")


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry and FEATURES (double) of each row's whole text, in built-in functions; null text: empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = F.trim(F.translate("__t", GAPS[1:], " " * (len(GAPS) - 1)))
    d = docs.select(*carry, text.alias("__t")).withColumn("__flat", flat)
    has = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    d = d.select(
        *carry,
        F.when(F.col("__flat") == "", F.array().cast("array<string>")).otherwise(F.split("__flat", " +")).alias("__w"),
        F.split("__t", "\n", -1).alias("__l"),
        F.length("__t").alias("__n"),
        F.greatest(F.length(F.translate("__t", GAPS, "")), F.lit(1)).alias("__v"),
        F.regexp_count("__t", F.lit("\\p{Lu}")).alias("upper"),
        has("!").alias("bang"), has("|").alias("pipe"), has(SYMBOLS.replace("|", "")).alias("symbol"), has("0123456789").alias("digit"), has(".").alias("stop"), has(",").alias("comma"),
    )
    d = d.withColumn("__words", F.greatest(F.size("__w"), F.lit(1)))
    share = lambda name, of: (F.col(name) / F.col(of)).alias(name)
    return d.select(
        *carry,
        F.log1p("__n").alias("log_chars"), F.log1p(F.size("__w")).alias("log_words"), (F.col("__v") / F.col("__words")).alias("word_len"),
        *(share(x, "__v") for x in ("upper", "bang", "pipe", "symbol", "digit", "stop", "comma")),
        (F.size(F.array_distinct("__w")) / F.col("__words")).alias("distinct"),
        (F.array_max(F.transform("__l", lambda x: F.length(x))) / F.greatest("__n", F.lit(1))).alias("longest_line"),
        (1 - F.size(F.array_distinct("__l")) / F.size("__l")).alias("dup_line"),
        (F.size("__w") / F.size("__l")).alias("words_a_line"),
    )


#: A condition: feature number, threshold, and whether the feature must be greater.
Condition = tuple[int, float, bool]


@dataclass
class RuleModel:
    base: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def expression(self) -> Column:
        """The score, 0 to 1, over the FEATURES columns."""
        met = lambda rule: [F.col(FEATURES[f]) > cut if more else F.col(FEATURES[f]) <= cut for f, cut, more in rule]
        both = lambda parts: parts[0] if len(parts) == 1 else parts[0] & both(parts[1:])
        terms = [F.when(both(met(rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-total([F.lit(self.base), *terms])))


def applies(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, more in rule:
        out &= x[:, f] > cut if more else x[:, f] <= cut
    return out


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    """For each feature, the thresholds that trees may use: quantiles, and quantiles of what isn't the most
    frequent value."""
    out = []
    for v in x.T:
        values, n = np.unique(v, return_counts=True)
        rest = v[v != values[n.argmax()]]
        grid = np.linspace(0, 1, CUTS + 2)[1:-1]
        cuts = np.quantile(v, grid) if not len(rest) else np.concatenate([np.quantile(v, grid), np.quantile(rest, grid), [values[n.argmax()]]])
        out.append(np.unique(cuts))
    return out


def tree_paths(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, out: dict[tuple[Condition, ...], None]) -> None:
    """Adds every path of one tree, grown on a random half of the rows with half of the features a node.
    codes: for each value, the number of the feature's cuts below it."""

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            out.setdefault(tuple(sorted(path)))
        n, share = len(rows), y[rows].mean()
        if len(path) == DEPTH or n < 2 * MIN_LEAF or share in (0, 1):
            return
        best = (1e-9, None)
        for f in rng.choice(x.shape[1], -(-x.shape[1] // 2), replace=False):
            if not len(cuts[f]):
                continue
            size = np.bincount(codes[rows, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
            ones = np.bincount(codes[rows, f], y[rows], minlength=len(cuts[f]) + 1).cumsum()[:-1]
            ok = (size >= MIN_LEAF) & (n - size >= MIN_LEAF)
            a, b = ones / np.maximum(size, 1), (y[rows].sum() - ones) / np.maximum(n - size, 1)
            gain = np.where(ok, share * (1 - share) - (size * a * (1 - a) + (n - size) * b * (1 - b)) / n, 0)
            if gain.max() > best[0]:
                best = (gain.max(), (int(f), float(cuts[f][gain.argmax()])))
        if best[1]:
            f, cut = best[1]
            high = x[rows, f] > cut
            grow(rows[high], (*path, (f, cut, True)))
            grow(rows[~high], (*path, (f, cut, False)))

    grow(rng.choice(len(x), max(len(x) // 2, min(len(x), 2 * MIN_LEAF)), replace=False), ())


def lasso_logistic(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the base isn't penalised. Rows that meet the same rules are counted
    together, which changes no sum."""
    n, m = r.shape
    _, first, at = np.unique(np.packbits(r > 0, axis=1), axis=0, return_index=True, return_inverse=True)
    r, size, ones = r[first], np.bincount(at.ravel()), np.bincount(at.ravel(), y)
    step = 4 / (np.linalg.eigvalsh(r.T @ (r * size[:, None]))[-1] / n + 1)
    w, base, wz, bz, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        wrong = size / (1 + np.exp(-(r @ wz + bz))) - ones
        new = wz - step * (r.T @ wrong) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        b = bz - step * wrong.sum() / n
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wz, bz = new + (t - 1) / t2 * (new - w), b + (t - 1) / t2 * (b - base)
        w, base, t = new, b, t2
    return base, w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Deterministic for given rows in given order."""
    if not len(y):
        return RuleModel()
    if y.min() == y.max():
        return RuleModel(base=3.0 if y[0] else -3.0)
    rng = np.random.default_rng(seed)
    paths: dict[tuple[Condition, ...], None] = {}
    cuts = cut_points(x)
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    for _ in range(TREES):
        tree_paths(x, codes, cuts, y, rng, paths)
    rules, r, seen = [], [], set()
    for rule in paths:
        hit = applies(rule, x)
        if hit.any() and not hit.all() and (mark := hit.tobytes()) not in seen:
            seen.add(mark)
            rules.append(rule)
            r.append(hit)
    if not rules:
        return RuleModel(base=float(np.log(y.mean() / (1 - y.mean()))))
    r = np.stack(r, 1).astype(np.float64)
    test = rng.random(len(y)) < 0.2
    if test.all() or not test.any():
        test = np.arange(len(y)) % 5 == 0

    def loss(strength: float) -> float:
        base, w = lasso_logistic(r[~test], y[~test], strength)
        p = np.clip(1 / (1 + np.exp(-(r[test] @ w + base))), 1e-6, 1 - 1e-6)
        return -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()

    base, w = lasso_logistic(r, y, min(STRENGTHS, key=loss))
    return RuleModel(float(base), [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Learns quality (0 or 1) of labels (doc_id, quality) from the texts of docs.

    About TRAINING labelled documents at most, chosen by a hash of their id; labels that are null or
    belong to no document are left out, and the greatest of several labels counts, as does one row of
    statistics of several rows with one id. Only these statistics reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = min(1.0, TRAINING / max(n, 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)).withColumnRenamed("quality", "__y")
    # `some` is bounded by TRAINING, and so are the rows, one for each id.
    rows = features(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), ["doc_id", "__y"])
    rows = rows.groupBy("doc_id", "__y").agg(F.min(F.struct(*FEATURES)).alias("f")).select("doc_id", "__y", "f.*").toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], ignore_index=True)
    return fit(rows[list(FEATURES)].to_numpy(np.float64), (rows["__y"].to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, model: RuleModel, carry: list[str], out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """carry, score (0 to 1) and predicted (1 if score >= THRESHOLD, else 0) for each row of docs, from its
    text alone; out: the names of the last two. Null text scores as empty text; without labels every score
    is 0.5. Columns of docs may have any name but those in out."""
    own = [f"__c{i}" for i in range(len(carry))]
    d = docs.select(*(F.col(c).alias(o) for c, o in zip(carry, own, strict=True)), F.col("text").alias("text"))
    scored = features(d, own).select(*own, model.expression().alias("__score"))
    return scored.select(*(F.col(o).alias(c) for c, o in zip(carry, own, strict=True)), F.col("__score").alias(out[0]), (F.col("__score") >= THRESHOLD).cast("int").alias(out[1]))
