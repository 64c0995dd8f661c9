import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sourcelens.llm import common, langid


def test_every_counted_gram_is_kept(spark):
    """A language of more than 200 000 distinct 4-grams, most of them seen once, some twice, beside a small one."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x9FA0)]
    rare = ["".join(rng.choices(letters, k=50_000)) for _ in range(5)]
    texts = [*(("zh", t) for t in [*rare, rare[0][:20_000]]), ("en", "the cat sat on the mat and the hat")]
    model = langid.train(spark.createDataFrame(texts, "lang string, text string"))
    assert model.langs == ["en", "zh"]
    tables = model.tables()
    keys, n = np.unique(np.concatenate([langid.windows([t])[0] for lang, t in texts if lang == "zh"]), return_counts=True)
    assert len(keys) > 200_000 and np.array_equal(keys, tables.levels[1][0][0])
    once, twice = (n == 1).sum(), (n == 2).sum()
    assert once and twice
    whole = langid._Kneser(keys, n)
    assert abs(whole.levels[4][2] - once / (once + 2 * twice)) < 1e-12
    assert np.allclose(tables.levels[1][0][1], np.log2(whole.probability(4, keys)), atol=1e-4)
    assert len(tables.levels[0][0][0]) < 100
    assert langid.train(spark.createDataFrame(texts, "lang string, text string").where(F.lit(False))) is None


def naive_units(text):
    """Letters and marks in lower case, other runs as one space, none at the start."""
    out = []
    for c in text:
        keep = unicodedata.category(c)[0] in "LM"
        if keep:
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return ["\0"] * 3 + out


class NaiveKneserNey:
    """The definition, with dictionaries: counts of 4-grams, continuation counts below."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            u = naive_units(t)
            top.update(tuple(u[i : i + 4]) for i in range(len(u) - 3))
        self.counts = {4: top}
        for order in (3, 2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for order, c in self.counts.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[order] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.total[order], self.kinds[order] = Counter(), Counter()
            for g, v in c.items():
                self.total[order][g[:-1]] += v
                self.kinds[order][g[:-1]] += 1

    def p(self, gram):
        if not gram:
            return 2**-12
        order, context, lower = len(gram), gram[:-1], self.p(gram[1:])
        if context not in self.total[order]:
            return lower
        d, n = self.discount[order], self.total[order][context]
        return max(self.counts[order][gram] - d, 0) / n + d * self.kinds[order][context] / n * lower

    def entropy(self, text):
        u = naive_units(text)
        grams = [tuple(u[i : i + 4]) for i in range(len(u) - 3)]
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


def test_entropies_are_those_of_the_definition(spark, data):
    docs = common.table(spark, data, "documents").where("lang is not null").orderBy("doc_id").limit(60)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    learnt, held = rows[:40], [*rows[40:], ("?", "日本語 x"), ("?", "Ⅻ ʼn İstanbul"), ("?", "z")]
    model = langid.train(spark.createDataFrame(learnt, "lang string, text string"))
    naive = [NaiveKneserNey([t for lang, t in learnt if lang == x]) for x in model.langs]
    assert len(naive) > 2
    got, n = model.tables().entropies([t for _, t in held])
    for row, units, (_, text) in zip(got, n, held, strict=True):
        assert units == len(naive_units(text)) - 3
        assert np.allclose(row, [m.entropy(text) for m in naive], atol=1e-4)


def test_long_texts_and_ties(spark, monkeypatch):
    same = [("b", "one two three"), ("a", "one two three")]
    model = langid.train(spark.createDataFrame(same, "lang string, text string"))
    docs = spark.createDataFrame([(1, "two"), (2, "two " * 5_000), (2, "two " * 5_000)], "doc_id int, text string")
    got = langid.identify(docs, model).collect()
    assert [r["lang_pred"] for r in got] == ["a"] * 3 and all(abs(r["score"] - 0.5) < 1e-9 for r in got)
    whole = model.tables().entropies(["two three " * 300])[0]
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(model.tables().entropies(["two three " * 300])[0], whole)


def kneser_table(texts_by_lang, langs):
    rows = []
    for lang, texts in texts_by_lang.items():
        keys, n = np.unique(np.concatenate([langid.windows([t])[0] for t in texts]), return_counts=True)
        rows += langid._tables(pa.table({"lang": [lang] * len(keys), "model": pa.array([0] * len(keys), pa.int32()), "gram": keys.view(np.int64), "n": n})).to_pylist()
    return langid.Tables(rows, langs)


def test_calibration_leaves_each_text_out(spark):
    """More than 4000 texts, and a language of few; each text is scored by a model of the other folds."""
    rng = random.Random(5)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60)] for x, letters in (("en", "etaoinshr"), ("fr", "etaoinsué"))}
    texts = [(x, " ".join(rng.choices(words[x], k=rng.randint(1, 8)))) for x, n in (("en", 4200), ("fr", 25)) for _ in range(n)]
    texts += [("en", "".join(rng.choices("qxzjk", k=12))) for _ in range(60)]
    df = spark.createDataFrame([*texts, ("en", ""), ("fr", "12"), ("en", None), (None, "x")], "lang string, text string")
    model = langid.train(df)
    folds = [(r["lang"], r["fold"], r["text"]) for r in langid.folded(df).collect()]
    assert {f for _, f, _ in folds} == set(range(langid.FOLDS)) and len(folds) == len(texts) + 2
    own, loss = {x: [] for x in model.langs}, Counter()
    for f in range(langid.FOLDS):
        others = {x: [t for lang, k, t in folds if lang == x and k != f] for x in model.langs}
        tables, held = kneser_table(others, model.langs), [(lang, t) for lang, k, t in folds if k == f]
        e, n = tables.entropies([t for _, t in held])
        for i, (lang, _) in enumerate(held):
            if n[i]:
                k = model.langs.index(lang)
                own[lang].append(e[i, k])
                for t in langid.TEMPERATURES:
                    loss[t] -= np.log(max(model.confidence(e[i : i + 1], n[i : i + 1], t)[0, k], 1e-9))
    assert math.isclose(model.limit[0], np.quantile(own["en"], 0.995), rel_tol=1e-6)
    assert math.isclose(model.limit[1], max(own["fr"]) + 3 * np.std(own["fr"], ddof=1) * math.sqrt(1 + 1 / len(own["fr"])), rel_tol=1e-5)
    assert model.temperature == min(loss, key=loss.get)


def test_held_out_rejections(spark):
    """The share of right texts that are rejected, with many and with few training texts."""
    data = "/root/testdata/sf0.1"
    docs = common.table(spark, data, "documents").where("lang is not null").withColumn("r", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    held = docs.where("r % 4 = 2")
    for learn, most in ((docs.where("r % 4 <> 2"), 0.01), (docs.where("r % 4 <> 2 and r % 20 = 1"), 0.02)):
        got = langid.identify(held, langid.train(learn.select("lang", "text"))).join(held.select("doc_id", "lang"), "doc_id")
        sums = got.where("lang = lang_pred").agg(F.count("*").alias("n"), F.count_if("rejected").alias("out")).first()
        assert sums["n"] > 2000 and sums["out"] <= most * sums["n"], sums


def test_forty_shards_are_one(monkeypatch):
    texts = {"en": ["the cat sat on the mat", "a hat and a bat", "words of many kinds stand here"], "de": ["der Hund und die Katze"]}
    langs = ["de", "en", "xx"]  # of xx there is nothing
    whole = kneser_table(texts, langs)
    monkeypatch.setattr(langid, "SHARD", 2)
    cut = kneser_table(texts, langs)
    e, f = (t.entropies(["the hat of words", "Hund", "éé"])[0] for t in (whole, cut))
    assert np.array_equal(e, f) and np.allclose(e[:, 2], langid.UNITS)
    rows = langid._tables(pa.table({"lang": ["en"] * 100, "model": pa.array([0] * 100, pa.int32()), "gram": np.arange(100) << 16, "n": np.ones(100, np.int64)})).to_pylist()
    assert max(r["part"] for r in rows) == 49


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    own = {"a": rng.random(1234), "b": np.r_[np.full(3000, 0.25), rng.random(7)], "c": np.array([2.5]), "d": np.array([-1e-16, 0.0, 3.0])}
    values = spark.createDataFrame([(x, float(v)) for x, vs in own.items() for v in vs], "lang string, own double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = langid.quantiles(values, q)
        assert {x: n for x, (n, _) in got.items()} == {x: len(v) for x, v in own.items()}
        assert all(np.isclose(got[x][1], np.quantile(v, q), rtol=1e-12) for x, v in own.items())
