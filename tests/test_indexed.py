"""The stored index, the rounds over it, and what queries keep."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sourcelens.functions import query as Q
from sourcelens.operators import adaptive, index
from sourcelens.plans.calls import DeadlineExceeded
from sourcelens.plans.context import Engine
from sourcelens.plans.indexed import IndexedEngine
from sourcelens.plans.stored_index import StoredIndex
from sourcelens.sources.corpora import Table, Tree

SCHEMA = "path string, text string"


def rows_of(spark, files):
    return spark.createDataFrame(list(files.items()), SCHEMA)


def update(ix, spark, files, complete=True):
    listed = Table(rows_of(spark, files))
    states = ix.states(listed.files()[0].where("reason is null"), complete)
    wanted = states.where("state in ('missing', 'changed')").withColumn("place", F.xxhash64("path"))
    ix.update(states, listed.texts(wanted).join(wanted.select("path", "place"), "path"))


def contents(ix):
    live = ix.documents().select("path", "segment")
    post = ix._read(f"{ix.root}/postings", "term string, path string, tf bigint, segment string, bucket int").join(live, ["path", "segment"])
    grams = ix._read(f"{ix.root}/grams", "gram string, path string, segment string, bucket int").join(live, ["path", "segment"])
    return sorted((r["path"], r["term"], r["tf"]) for r in post.collect()), sorted((r["path"], r["gram"]) for r in grams.collect())


def anew(spark, files):
    c = rows_of(spark, files)
    return sorted((r["path"], r["term"], r["tf"]) for r in index.postings(c).collect()), sorted((r["path"], r["gram"]) for r in index.gram_sketch(c).collect())


def test_three_edits_are_an_index_made_anew(spark, tmp_path, monkeypatch):
    ix = StoredIndex(spark, f"file://{tmp_path}/ix", buckets=3)
    first = {"a.rs": "fn alphaBeta() {}", "b.rs": "beta beta gamma", "c.rs": "delta", "u.rs": "ユーザー認証"}
    second = {"a.rs": "fn alphaBeta() {}", "b.rs": "gamma only", "d.rs": "epsilon alpha", "u.rs": "ユーザー認証"}
    third = {"a.rs": "changed twice", "b.rs": "beta beta gamma", "d.rs": "epsilon alpha"}
    for n, files in enumerate((first, second, third), 1):
        update(ix, spark, files)
        assert contents(ix) == anew(spark, files)
        m = ix.manifest
        assert (m.version, m.documents, len(m.segments)) == (n, len(files), n) and not m.saturated
        assert m.entries == sum(map(len, contents(ix)))
    # Another process sees the same version, and only the wanted buckets are read.
    other = StoredIndex(spark, f"file://{tmp_path}/ix")
    assert other.manifest == ix.manifest and contents(other) == contents(ix)
    got = {r["path"]: (r["tf0"], r["tf1"], r["dl"]) for r in other.frequencies(["alpha", "gamma"]).collect()}
    assert got == {"d.rs": (2, 0, 2), "b.rs": (0, 2, 3)}
    # A delta that finds everything gone, unless discovery was incomplete.
    update(other, spark, {"a.rs": "changed twice"}, complete=False)
    assert other.manifest.documents == 3
    with pytest.raises(RuntimeError, match="another process"):
        update(ix, spark, {"a.rs": "lost"})
    ix.refresh()
    assert ix.manifest == other.manifest
    monkeypatch.setattr("sourcelens.plans.stored_index.MERGED_AT", 2)
    update(ix, spark, {"b.rs": "beta beta gamma", "e.rs": "new"})
    assert len(ix.manifest.segments) == 1 and contents(ix) == anew(spark, {"b.rs": "beta beta gamma", "e.rs": "new"})
    assert ix.vacuum() > 0 and contents(ix) == anew(spark, {"b.rs": "beta beta gamma", "e.rs": "new"})
    assert os.listdir(f"{tmp_path}/ix/manifest") and len([x for x in os.listdir(f"{tmp_path}/ix/manifest") if x.endswith(".json") and not x.startswith(".")]) == 1


def test_failed_update_is_invisible(spark, tmp_path, monkeypatch):
    ix = StoredIndex(spark, f"file://{tmp_path}/ix")
    update(ix, spark, {"a.rs": "one", "b.rs": "two"})
    before = contents(ix)
    with monkeypatch.context() as m:
        m.setattr(StoredIndex, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            update(ix, spark, {"a.rs": "other"})
    assert contents(ix) == before == contents(StoredIndex(spark, f"file://{tmp_path}/ix"))


def test_cap_of_entries(spark, tmp_path):
    """Documents join in order until one would pass the cap."""
    ix = StoredIndex(spark, f"file://{tmp_path}/ix", cap=30)
    listed = Table(rows_of(spark, {"a.rs": "abc", "b.rs": "def", "c.rs": " ".join(f"word{i}" for i in range(40))}))
    states = ix.states(listed.files()[0])
    texts = listed.texts(states).withColumn("place", F.when(F.col("path") == "a.rs", 1).when(F.col("path") == "c.rs", 2).otherwise(3))
    ix.update(states, texts)
    assert ix.manifest.saturated and [r["path"] for r in ix.documents().collect()] == ["a.rs"]


# --- Queries over it. ---
def engine(spark, tmp_path, corpus, **more):
    return IndexedEngine(spark, corpus, StoredIndex(spark, f"file://{tmp_path}/ix", buckets=2), **more)


def write(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_as_the_whole_scan(spark, tmp_path, data):
    """Over documents, hits are those of the engine that reads everything, but that frequencies of documents come
    from the index, whose grams nominate more (test_no_twin holds them to the rules): evidence is the same."""
    from sourcelens.queries import QUERY, docs

    corpus = docs(spark, data)
    whole, indexed = Engine(spark, corpus).context(QUERY), engine(spark, tmp_path, Table(corpus)).context(QUERY)
    evidence = lambda c: {h["path"]: (h["start_line"], h["end_line"], h["excerpt"], h["fingerprint"]) for h in c.hits}
    both = evidence(whole).keys() & evidence(indexed).keys()
    assert len(both) > len(whole.hits) // 2 and all(evidence(whole)[p] == evidence(indexed)[p] for p in both)
    assert indexed.coverage["indexed"] == 200 and indexed.coverage["complete"] and indexed.text.startswith("[UNTRUSTED")


def test_verification_advances_over_rounds(spark, tmp_path):
    """A quarter of 512 KiB verifies one of two files of 100 KiB; the next round goes on with the other."""
    text = "fn alpha() {}\n" + " " * (100 * 1024)
    e = engine(spark, tmp_path, Table(rows_of(spark, {"a.rs": text, "b.rs": text})))
    q = Q.normalize("alpha")
    state = e._listed(q)
    first, more = e.search_once(q, state, 512 * 1024)
    assert [h["path"] for h in first.hits] == ["a.rs"] and more and first.truncated
    read = state.used["scanned_bytes"]
    second, more = e.search_once(q, state, 512 * 1024)
    assert [h["path"] for h in second.hits] == ["a.rs", "b.rs"] and not more and not second.truncated
    assert state.used["scanned_bytes"] - read == len(text)


def test_rounds_grow_the_index(spark, tmp_path):
    files = {f"d{i % 7}/f{i:03d}.txt": f"needle{i} " + "pad " * 250 for i in range(24)}
    e = engine(spark, tmp_path, Table(rows_of(spark, files)), first=8 << 10, cap=1 << 20)
    got = e.context("needle23 absent")
    assert got.coverage["rounds"] > 1 and got.hits[0]["path"].endswith("f023.txt")
    small = engine(spark, tmp_path / "2", Table(rows_of(spark, files)), first=8 << 10, cap=8 << 10).context("needlexyz absent")
    assert small.truncated and 0 < small.coverage["indexed"] < 24 and small.coverage["rounds"] == 1


def test_reuse_change_and_cache(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, {"src/a.rs": "fn alpha() { beta(); }\n", "src/b.rs": "pub fn beta() {}\n"})
    e = engine(spark, tmp_path, Tree(spark, str(root)))
    none = e.context("zzzzmissing")
    assert not none.hits and none.coverage["scanned_files"] == 2 and not none.truncated
    again = e.context("zzzzmissing")
    assert again.coverage["scanned_files"] == again.coverage["scanned_bytes"] == 0
    one = e.context("alpha beta")
    assert one.hits and e.parsed == 2
    two = e.context("alpha beta")
    shown = lambda c: [(h["path"], h["start_line"], h["excerpt"], h["fingerprint"]) for h in c.hits]
    assert shown(two) == shown(one) and e.parsed == 2 and two.coverage["scanned_files"] == 0  # scores move, as it's remembered
    write(root, {"src/b.rs": "pub fn beta() { needle_here(); }\n"})
    changed = e.context("needle_here")
    assert [h["path"] for h in changed.hits] == ["src/b.rs"] and changed.coverage["scanned_files"] == 2  # indexed, then verified
    os.remove(root / "src/b.rs")
    assert e.context("needle_here").hits == [] and e.index.manifest.documents == 1
    assert [h["path"] for h in IndexedEngine(spark, Tree(spark, str(root)), StoredIndex(spark, f"file://{tmp_path}/ix")).context("alpha").hits] == ["src/a.rs"]


def test_skips_are_remembered(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, {"ok.rs": "fn alpha() {}", "bad.rs": b"\xff\xfe\xfd\x00"})
    e = engine(spark, tmp_path, Tree(spark, str(root)))
    got = e.context("definitely_missing")
    assert got.coverage["excluded"] == 1 and not got.truncated and got.confidence == 0.35 and got.coverage["eligible"] == 1
    assert [(r["path"], r["reason"]) for r in e.index.skips().collect()] == [("bad.rs", "non_utf8")]
    seen = []
    texts = e.source.texts
    e.source.texts = lambda paths: seen.extend(r["path"] for r in paths.collect()) or texts(paths)
    assert e.context("definitely_missing").coverage["excluded"] == 1 and seen == []
    write(root, {"bad.rs": "fn mended() {}"})
    assert [h["path"] for h in e.context("mended").hits] == ["bad.rs"] and e.index.skips().count() == 0


def test_gram_candidates_that_the_text_does_not_bear_out(spark, tmp_path):
    files = {f"candidate-{i:03d}.rs": "abc___bcd" for i in range(129)}
    got = engine(spark, tmp_path, Table(rows_of(spark, files))).context("abcd")
    assert got.hits == [] and got.truncated and got.coverage["rounds"] == 1 and got.confidence == 0.05


def test_last_round_is_the_late_answer(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path, Table(rows_of(spark, {"a.rs": "fn alpha() {}", "b.rs": "alpha"})))

    def late(*_):
        raise DeadlineExceeded("the deadline came while the map was made")

    monkeypatch.setattr(IndexedEngine, "structural_map", late)
    got = e.context("alpha", session_id="s")
    assert got.late and got.truncated and [h["path"] for h in got.hits] == ["a.rs", "b.rs"] and e.seq == 0
    with pytest.raises(DeadlineExceeded):
        e.context("alpha", seconds=0.001)


def test_redacted_and_path_only(spark, tmp_path):
    secret = "sk-abcdefghijklmnopqrstuvwxyz0123456789"
    e = engine(spark, tmp_path, Table(rows_of(spark, {"safe.rs": f'let token = "{secret}";', "src/middleware.rs": "pub fn verify() {}"})))
    (hit,) = e.context(secret).hits
    assert hit["start_line"] == 0 and secret not in hit["excerpt"]
    (hit,) = e.context("middleware gateway").hits
    assert (hit["path"], hit["score"], hit["excerpt"]) == ("src/middleware.rs", 3.0, "")


def test_what_changes_meanwhile_is_not_shown(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    write(root, {"a.rs": "fn alpha() {}\n", "b.rs": "fn beta() { alpha(); }\n"})
    e = engine(spark, tmp_path, Tree(spark, str(root)))
    whole = IndexedEngine.structural_map

    def slow_map(self, *args):
        entries = whole(self, *args)
        write(root, {"b.rs": "fn beta() { other(); }\n"})
        return entries

    with monkeypatch.context() as m:
        m.setattr(IndexedEngine, "structural_map", slow_map)
        got = e.context("alpha")
    assert [h["path"] for h in got.hits] == ["a.rs"] and got.coverage["invalidated"] == 1 and got.truncated and "b.rs" not in got.text.split("EVIDENCE")[0]
    again = e.context("alpha")
    assert [h["path"] for h in again.hits] == ["a.rs"] and "invalidated" not in again.coverage and not again.truncated


def test_budget_rounds_are_the_fold(spark, monkeypatch):
    items = spark.range(900).select((F.col("id") % 3).alias("g"), "id", (F.xxhash64("id") % 97 + 97).alias("size"), F.lit("x").alias("taken_before"))
    want = sorted(map(tuple, adaptive._folded(items, "g", ["id"], "size", 5000).collect()))
    monkeypatch.setattr(adaptive, "FOLDED", 100)
    assert sorted(map(tuple, adaptive.fit_budget(items, "g", ["id"], "size", 5000).collect())) == want
    assert len({t for *_, t in want}) == 2


def test_confidence_on_the_driver(spark):
    for hits in ([], [("a/tok", "x", 30.0)], [("a", "token ther", 30.0), ("b", "ther", 30.0), ("c", "x", 1.5), ("d", "license", 0.5)]):
        df = spark.createDataFrame(hits, "path string, excerpt string, score double")
        for cut, excluded in ((False, 0), (True, 0), (False, 2)):
            want = adaptive.confidence(df, ["token", "ther"], F.lit(3), F.lit(4), F.lit(cut), F.lit(excluded)).first()[0]
            got = adaptive.confidence_of([{"path": p, "excerpt": x, "score": s} for p, x, s in hits], ["token", "ther"], 3, 4, cut, excluded)
            assert got == pytest.approx(want)


def test_cache_by_stamp(spark, monkeypatch):
    """The newest generation of a path counts, one without rows is known, and the paths put last stay."""
    from sourcelens.plans import cache

    monkeypatch.setattr(cache, "PARTS", 3)
    c = cache.StampCache(spark, "t", "n int", capacity=2)
    keys = lambda *r: spark.createDataFrame(r, "path string, stamp string")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, stamp string, n int")
    assert c.probe(keys(("a", "1")))[1].count() == 1
    c.put(keys(("a", "1"), ("b", "1")), rows(("a", "1", 10)))
    c.put(keys(("a", "2")), rows(("a", "2", 20), ("a", "2", 21)))
    got, missing = c.probe(keys(("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")))
    assert sorted(map(tuple, got.collect())) == [("a", "2", 20), ("a", "2", 21)]
    assert sorted(map(tuple, missing.collect())) == [("a", "1"), ("c", "1")]
    for k in range(5):  # rewritten on the way, and old files go
        c.put(keys((f"p{k}", "1")), rows((f"p{k}", "1", k)))
        assert c.probe(keys((f"p{k}", "1")))[0].collect()[0]["n"] == k
    assert len(c.parts) < 3 and c.probe(keys(("a", "2"), ("p0", "1")))[1].count() == 2
