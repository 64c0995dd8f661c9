"""Line dedup, quality rules and Merkle fingerprints: SQL twins and odd tables."""

import pytest
from pyspark.sql import functions as F

from sourcelens.llm import common, line_dedup, merkle, quality_rules
from sourcelens.llm import queries as Q
from tests.oracle import same

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, lines string, `t` string"
LONG = "word " * 30_000
ROWS = [
    (1, "a b c d e a b c d e\nx\nx", "en", "s", 1, "h", "l", "t"),
    (1, "a b c d e a b c d e\nx\nx", "en", "s", 1, "h", "l", "t"),
    (2, "", None, None, None, None, None, None),
    (3, None, "en", "s", 0, None, None, None),
    (4, LONG, "en", None, 1, "h", "l", "t"),
    (None, "no id\n\n", "en", "s", 1, "h", "l", "t"),
    (5, " \t\n", "en", "s", 1, "h", "l", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_twins(spark, data, name):
    same(Q.queries()[name](spark, data), Q.oracle_sql()[name], data)


def naive_stats(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 1000 else set(range(len(words)))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_odd(odd):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ROWS)
    want = sorted(((r[0], *naive_stats(r[1])) for r in ROWS), key=str)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=str)
    assert got == want
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_adaptive_fences(spark):
    """A source's own habit passes, and what is odd for it goes."""
    rows = [(i, f"plain words number {i} " + " ".join(f"w{i}x{k} ||" for k in range(20)), "en", "tables") for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{i}y{k}" for k in range(25)), "en", "prose") for i in range(150)]
    rows.append((5000, " ".join(f"q{k} ||" for k in range(25)), "en", "prose"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert kept[0] and kept[1000] and not kept[5000] and sum(kept.values()) == 300


def test_line_dedup_odd(odd, spark):
    out = line_dedup.drop_boilerplate(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == len(ROWS)
    assert line_dedup.drop_boilerplate(odd.limit(0)).count() == 0
    rows = [(i, None if i == 9 else f"own {i}\nshared\n\nshared" if i < 5 else f"own {i}", "a" if i < 8 else None) for i in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), ratio=0.5).collect()}
    assert got[0]["text"] == "own 0\n" and got[0]["n_dropped"] == 2 and got[7]["text"] == "own 7" and got[9]["text"] is None


def test_merkle_odd(odd):
    rows = merkle.fingerprint_documents(odd).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0] == by[1][1]
    assert by[2][0]["fingerprint"] == by[3][0]["fingerprint"] and by[3][0]["n_chars"] == 0
    assert by[None][0]["n_chars"] == 7
    import hashlib

    half = len(LONG) // 2  # the next document of 4 is 3, whose text is empty
    assert by[4][0]["edited_sha256"] == hashlib.sha256(LONG[: len(LONG) - half].encode()).hexdigest()
    assert merkle.fingerprint_documents(odd.limit(0)).count() == 0


def test_merkle_locates_edits(spark):
    text = "\n".join(f"line {i} of the text with some words in it" for i in range(6))
    rows = spark.createDataFrame([(1, text, text.replace("line 3", "line x"))], "doc_id int, a string, b string")
    p = merkle.with_fingerprint(rows, "a", "fa", ["b"])
    p = merkle.with_fingerprint(p, "b", "fb", ["fa"])
    got = p.select(merkle.differing_sections(F.col("fa"), F.col("fb")).alias("at"), merkle.nodes(F.col("fa")).alias("x"), merkle.nodes(F.col("fb")).alias("y")).select("at", merkle.likeness("x", "y").alias("near")).first()
    assert got["at"] == [3] and 0.7 < got["near"] < 1


def stored_stats(docs):
    return common.materialize(quality_rules.with_metrics(quality_rules.document_stats(docs)), "stats")


def page(i, words, extra=""):
    return " ".join(f"{chr(97 + (i * 7 + k) % 26)}{i}w{k:02d}" for k in range(words)) + "\n" + "\n".join(f"line {i} {k} of it" for k in range(8)) + extra


@pytest.mark.parametrize(
    ("metric", "odd"),
    [
        ("symbol_pm", "".join(f" ${k}%" for k in range(30))),
        ("dup_line_pm", "".join(f"\nxy\nu{k}a u{k}b u{k}c u{k}d" for k in range(30))),
        ("repeat_pm", "\nqa qb qc qd qe qf qg" * 2),
        ("word_len10", " " + "longer" * 200),
        ("word_len10", "".join(f" {a} {b}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz")),
    ],
)
def test_each_metric_can_reject(spark, metric, odd):
    """Nothing but the group's own sketches decides; a document far from them goes by that metric."""
    rows = [(i, page(i, 40 + i % 20), "en", "s") for i in range(200)] + [(900, page(900, 50, odd), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    stats = stored_stats(docs)
    fence = quality_rules.fences(quality_rules.quantile_sketches(stats)).where("level = 0").first().asDict()
    row = stats.where("doc_id = 900").first()
    assert not row["base_failed"] and not fence[f"{metric}_low"] <= row[metric] <= fence[f"{metric}_high"]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert not kept.pop(900) and all(kept.values())


def test_fences_follow_their_group(spark):
    """Sources and languages of other habits get other fences for every metric, at every level."""
    rows = []
    for g, (words, extra) in enumerate([(40, ""), (90, " 5 % of $ 7 #\nsame line\nsame line")]):
        for i in range(150):
            long = "" if g == 0 else "".join(f" andaverylongone{i}x{k}" for k in range(30))
            rows.append((1000 * g + i, page(i, words + i % 30, extra * (i % 4)) + long, ["en", "de"][g], ["s", "t"][g]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    fences = quality_rules.fences(quality_rules.quantile_sketches(stored_stats(docs)))
    for level in (0, 1):
        fence = fences.where(f"level = {level}").orderBy("lang").collect()
        assert len(fence) == 2
        for m in quality_rules.METRICS:
            assert fence[0][f"{m}_high"] != fence[1][f"{m}_high"], m


def test_fences_on_documents(spark):
    """Recomputed from each group's rows with exact quantiles: every fence is the deciles and sizes of its own
    group, and clean labelled documents stay."""
    data = "/root/testdata/sf0.01"
    stats = stored_stats(common.table(spark, data, "documents"))
    rows = [r.asDict() for r in stats.where("not base_failed").collect()]
    got = {(r["level"], r["lang"], r["source"]): r.asDict() for r in quality_rules.fences(quality_rules.quantile_sketches(stats)).collect()}
    low = lambda x: x >> max(x.bit_length() - 7, 0) << max(x.bit_length() - 7, 0)
    width = lambda x: 1 << max(x.bit_length() - 7, 0)
    decile = lambda xs, k: sorted(map(low, xs))[-(-len(xs) * k // 10) - 1]
    for (level, lang, source), f in got.items():
        own = [r for r in rows if level == 3 or r["lang"] == lang and (level == 1 or r["source"] == source)]
        assert f["docs"] == len(own)
        for m, (size, event, _) in quality_rules.METRICS.items():
            a, b = decile([r[m] for r in own], 1), decile([r[m] for r in own], 9)
            room = 1000 * event // max(decile([r[size] for r in own], 1), 1) if size else 0
            assert (f[f"{m}_low"], f[f"{m}_high"]) == (a - 2 * (b - a) - width(a), b + 2 * (b - a) + width(b) + room)
    labels = {r["doc_id"] for r in common.table(spark, data, "labels").where("quality = 1").collect()}
    judged = {r["doc_id"]: r for r in quality_rules.judge(common.table(spark, data, "documents")).collect()}
    clean = [judged[i]["kept"] for i in labels if i in judged and not judged[i]["base_failed"]]
    assert len(clean) > 200 and sum(clean) > 0.98 * len(clean)
