"""Each stage of the pipeline, and the classifier's features, against plain versions over a whole table."""

import math
import unicodedata

import numpy as np
import pytest

from sourcelens.llm import common, pii, quality_classifier
from sourcelens.llm import queries as Q
from tests.llm.test_python import check_packing, codecs, naive_components, naive_fingerprint  # noqa: F401

GAPS = " \t\n\x0b\x0c\r"


def naive_features(text):
    text = text or ""
    words = [w for w in "".join(" " if c in GAPS else c for c in text).split(" ") if w]
    lines, visible, n = text.split("\n"), max(sum(c not in GAPS for c in text), 1), max(len(words), 1)
    share = lambda chars: sum(c in chars for c in text) / visible
    return [
        math.log1p(len(text)), math.log1p(len(words)), visible / n, sum(unicodedata.category(c) == "Lu" for c in text) / visible, share("!"), share("|"), share("#*$%&<>"), share("0123456789"), share("."), share(","),
        len(set(words)) / n, max(map(len, lines)) / max(len(text), 1), 1 - len(set(lines)) / len(lines), len(words) / len(lines),
    ]


def naive_score(model, text):
    x = naive_features(text)
    met = lambda rule: all(x[f] > cut if more else x[f] <= cut for f, cut, more in rule)
    return 1 / (1 + math.exp(-(model.base + sum(w for rule, w in model.rules if met(rule)))))


@pytest.fixture(scope="module")
def model(spark, data):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    return quality_classifier.train(docs, labels.where(Q.remainder(5) != 0))


def test_features_and_scores(spark, data, model):
    docs = common.table(spark, data, "documents")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "ÀÉ É|#9.,!\r\n" * 50), (-5, "x" * 100_000), (-6, "a\x0bb\x0cc\n\n")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in quality_classifier.features(rows, ["doc_id"]).collect():
        assert [r[f] for f in quality_classifier.FEATURES] == pytest.approx(naive_features(texts[r["doc_id"]]))
    assert len(model.rules) > 5
    for r in quality_classifier.score(rows, model, ["doc_id"]).collect():
        assert r["score"] == pytest.approx(naive_score(model, texts[r["doc_id"]]), abs=1e-6)


def test_hot_label(spark):
    """An id of many rows counts once, so what the driver gets is bounded by the labels."""
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(i, f"text {i}") for i in range(2, 6)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id bigint, quality int")
    seen = []
    quality_classifier_fit, quality_classifier.fit = quality_classifier.fit, lambda x, y: seen.append(x.shape) or quality_classifier.RuleModel()
    try:
        quality_classifier.train(docs, labels)
    finally:
        quality_classifier.fit = quality_classifier_fit
    assert seen == [(5, len(quality_classifier.FEATURES))]


def test_stages(spark, data, model, codecs):  # noqa: F811
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    docs = common.table(spark, data, "documents")
    plain = {r["doc_id"]: r.asDict() for r in docs.collect()}

    def run(name):
        nonlocal docs
        docs = common.materialize(stages[name](spark, docs, data), name)
        got = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert len(got) == docs.count()
        return got

    plain = {i: r for i, r in plain.items() if naive_score(model, r["text"]) >= quality_classifier.THRESHOLD}
    assert run("quality_classifier") == plain

    pages, having = {}, {}
    for r in plain.values():
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for line in set(r["text"].split("\n")):
            having[r["source"], line] = having.get((r["source"], line), 0) + 1
    for r in plain.values():
        boiler = lambda x, s=r["source"]: x.strip(" ") and having[s, x] >= 3 and having[s, x] > 0.08 * pages[s]
        r["text"] = "\n".join(x for x in r["text"].split("\n") if not boiler(x))
        r["n_chars"] = len(r["text"])
    assert run("line_dedup") == plain

    prints = {i: naive_fingerprint(r["text"]) for i, r in plain.items()}
    classes, first = naive_components(set(prints.values())), {}
    for i in sorted(plain):
        first.setdefault(classes[prints[i]], i)
    plain = {i: plain[i] for i in first.values()}
    assert run("simhash_near_dedup") == plain

    for r in plain.values():
        for kind, a, b in reversed(pii.spans(r["text"])[1]):
            r["text"] = f"{r['text'][:a]}[{kind.upper()}]{r['text'][b:]}"
        r["n_chars"] = len(r["text"])
    assert run("pii") == plain

    rows = stages["best_fit_packing"](spark, docs, data).collect()
    n = check_packing(rows, {i: r["text"] for i, r in plain.items()}, codecs[2])
    assert n <= sum(r["length"] for r in rows) / 2048 * 1.02 + 2
    starts = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == starts.get(r["doc_id"], 0)
        starts[r["doc_id"]] = r["start"] + r["length"]
    assert np.sum(list(starts.values())) == sum(r["length"] for r in rows)
