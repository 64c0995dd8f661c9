import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcelens.llm import periodic as P
from sourcelens.llm import queries as Q
from sourcelens.llm.common import table


def naive(words):
    """Every run by its definition: for each period, maximal stretches of words equal to those a period before;
    the first period that a stretch has is its smallest."""
    n, found = len(words), {}
    for q in range(1, n // P.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(P.SHORTEST, P.TIMES * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=5).flatmap(lambda b: st.integers(1, 9).map(lambda k: b * k)), max_size=8).map(lambda parts: sum(parts, [])))
def test_runs_by_definition(words):
    assert P.runs(words) == naive(words)
    ((_, found),) = P.find_in([" ".join(map(str, words)).encode()])
    assert found == naive(words)


def test_masking_together_is_masking_alone():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)) * rng.choice([1, 1, 4, 6])).encode() for _ in range(300)]
    together = list(P.find_in(texts))
    assert together == [next(P.find_in([t])) for t in texts]
    assert sum(bool(f) for _, f in together) > 50


def test_mask_drops_what_cannot_repeat():
    import numpy as np

    words = np.arange(3000)
    assert P.segments(words, np.zeros(3000, int)) == []
    words[1000:1012] = [7, 8, 9] * 4
    assert P.segments(words, np.zeros(3000, int)) == [(1000, 1012)]
    assert P.segments(words, np.r_[np.zeros(1006, int), np.ones(1994, int)]) == []  # not within one document


def reference(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = naive(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_query_against_brute_force(spark, data):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, data).collect()}
    docs = table(spark, data, "documents").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"] or "") < 12_000]
    assert len(got) == len(docs) and len(short) > 150
    for r in short:
        assert got[r["doc_id"]] == reference(r["doc_id"], r["text"]), r["doc_id"]
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 4), (4, "a b " * 4), (None, "x " * 6), (5, "x " * 5), (6, "z " + "é b c\n" * 5 + "y"), (7, "w" * 200_000), (8, "p q r s " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"n_runs": F.lit(1), "Start": F.lit("x"), "runs": F.lit(0)})
    got = sorted(P.collapse_documents(docs).collect(), key=str)
    at = {(r["doc_id"], r["n_runs"]): r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows)
    for i in (1, 2, 3):
        assert tuple(at[i, 0])[2:8] == (None, None, None, None, empty, empty) and at[i, 0]["collapsed"] == ""
    assert (at[4, 1]["start"], at[4, 1]["length"], at[4, 1]["period"], at[4, 1]["exponent_milli"], at[4, 1]["collapsed"]) == (0, 8, 2, 4000, "a b")
    assert at[None, 1]["collapsed"] == "x" and (5, 0) in at
    assert at[6, 1]["collapsed"] == "z é b c y" and at[6, 1]["period"] == 2
    assert at[8, 1]["collapsed"] == "p q r s" and at[8, 1]["length"] == 80_000
    assert P.collapse_documents(docs.where("doc_id > 100")).count() == 0
    planted = docs.select(P.with_planted_runs(F.col("text"), F.col("doc_id")).alias("t"), "text").collect()
    assert all((r["t"] is None) == (r["text"] is None) for r in planted)
