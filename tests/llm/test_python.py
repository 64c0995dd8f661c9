"""Packing, BPE, personal data, SimHash, language, quality, WARC: brute force and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcelens.llm import bpe, common, langid, packing, pii, quality_classifier, simhash, warc
from sourcelens.llm import queries as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, length string, score string, upper string"
LONG = "many words here " * 8_000
ROWS = [(1, "hello world, again", "en", "s", 1), (1, "hello world, again", "en", "s", 1), (2, "", None, None, None), (3, None, "en", "s", 0), (4, LONG, "en", None, 1), (None, "no id", "de", "s", 1), (5, "x", None, "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in common.table(spark, data, "documents").collect()}


PIECES = st.text(alphabet=st.sampled_from("ab the'sß日 \n\t\x1c\x85 _!1é😀"), max_size=40) | st.text(max_size=40)


@pytest.fixture(scope="module")
def codecs():
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(text=PIECES)
def test_bpe_is_exact(codecs, text):
    own, ref, hf = codecs
    assert own.encode(text) == ref.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()
    packed = packing.segment_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).ids([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, data, texts, odd, codecs):
    for r in Q.op10_byte_bpe(spark, data).collect():
        ids = codecs[1].encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == len(ROWS) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert bpe.encode_documents(odd.limit(0)).count() == 0


def test_bpe_long_run(codecs):
    s = "a" * 50_000 + "é" * 5_000
    assert codecs[0].encode(s) == codecs[1].encode_ordinary(s)


def check_packing(rows, texts, hf):
    sequences, tokens = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    for doc, text in texts.items():
        ids = hf.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(tokens[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["length"] <= 2048 and (r["length"] == 2048 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    return len(sequences)


def test_packing_query(spark, data, texts, codecs):
    rows = Q.op3_best_fit_packing(spark, data).collect()
    n = check_packing(rows, texts, codecs[2])
    assert n <= sum(r["length"] for r in rows) / 2048 * 1.02 + 2


def test_packing_odd(odd, codecs):
    rows = packing.pack_documents(odd).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    check_packing(rows, {}, codecs[2])
    assert sum(r["doc_id"] == 4 for r in rows) > 5
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    pieces = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 3 + 600).alias("length"), F.lit(1).cast("bigint").alias("ids_crc32"))
    rows = packing.pack(common.materialize(pieces, "x")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 100 and len({r["sequence_id"] for r in rows}) == 34


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=25))
def test_plan_is_best_fit_decreasing(counts):
    bins, used = [], {}
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [b for b in range(len(bins)) if bins[b] >= length]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= length
            else:
                bins.append(50 - length)
    for length, low, high, base, per, place in packing.plan_slots(counts, 50):
        for r in range(low, high):
            used.setdefault(base + (r - low) // per, []).append((place + (r - low) % per * length, length))
    assert len(used) == len(bins) and sum(map(len, used.values())) == sum(counts.values())
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_pii(text):
    out = []
    for k in pii.KINDS:
        for m in re.finditer(BASE[k], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            out += [(k, *m.span())] * ok[k]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(text=st.lists(st.sampled_from([*"ab.@-+%_ 0123()é\n", "@x.yy", ".1.2", "+1 (23", "4111 1111 1111 1111", "192.168.1.1"]), max_size=30).map("".join))
def test_pii_base(text):
    assert pii.detect(text) == naive_pii(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write john dot doe at example dot com now", [("email", "john dot doe at example dot com")]),
        ("x john(at)example(dot)com", [("email", "john(at)example(dot)com")]),
        ("john [at] example.com x", [("email", "john [at] example.com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("jo​hn@exa​mple.com", [("email", "jo​hn@exa​mple.com")]),
        ("call plus one five five five one two three four five six.", [("phone", "plus one five five five one two three four five six")]),
        ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("host 10 dot 0 dot 0 dot one", [("ip", "10 dot 0 dot 0 dot one")]),
        ("one of two at noon, dot.", []),
    ],
)
def test_pii_disguise(text, found):
    base, spans = pii.spans(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == found


@pytest.mark.parametrize("text", ["a" * 50_000, "1" * 50_000, "+1" + " " * 50_000, "@" * 20_000, "one dot " * 5_000, "a dot " * 5_000, "1." * 20_000, "[" * 20_000])
def test_pii_is_linear(text):
    import time

    began = time.time()
    pii.spans(text)
    assert time.time() - began < 5


def test_pii_query(spark, data, texts, odd):
    for r in Q.op6_pii(spark, data).collect():
        base = naive_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.find_pii(odd).count() == len(ROWS) and pii.find_pii(odd.limit(0)).count() == 0
    assert pii.redact_documents(odd).columns == odd.columns and pii.redact("a b@c.de f") == "a [EMAIL] f"


def naive_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def naive_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fl = list(root)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fl}


def test_simhash_query(spark, data, texts):
    fps = {i: naive_fingerprint(t) for i, t in texts.items()}
    comp, least = naive_components(fps.values()), {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    for r in Q.op7_simhash(spark, data).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == least[comp[fps[r["doc_id"]]]]


@pytest.mark.parametrize("pairwise", [simhash.PAIRWISE, 4])
def test_simhash_links(spark, monkeypatch, pairwise):
    """Random clouds of close fingerprints, with small and with large meetings."""
    rng = random.Random(5)
    fps = {0}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))))
    signed = np.array(sorted(fps), np.uint64)
    want = naive_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    forest = {int(f): int(f) for f in signed}
    pairs = []
    for keys in [np.concatenate([k for k in simhash.variants(signed)])]:
        whose = np.tile(signed, len(keys) // len(signed))
        order = np.argsort(keys, kind="stable")
        keys, whose = keys[order], whose[order]
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                pairs += list(zip(*simhash.link_meeting(int(keys[a]), np.unique(whose[a:b]))))

    def find(x):
        while forest[x] != x:
            x = forest[x]
        return x

    for a, b in pairs:
        forest[find(int(a))] = find(int(b))
    got = {}
    for f in fps:
        got.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_simhash_odd(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2} and {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 5, None]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in common.star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_language(spark, data, odd):
    out = Q.op8_language_id(spark, data).join(common.table(spark, data, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in out.collect() if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.train_and_identify(odd, F.lit(True)).collect()}
    assert {(2, "und"), (3, "und")} <= got and len(got) == 6
    assert langid.train_and_identify(odd.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.train_and_identify(odd, F.lit(False)).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    keys, _ = langid.windows(["the cat sat on the mat and the hat"])
    keys, n = np.unique(keys, return_counts=True)
    m = langid._Kneser(keys, n)
    chars = np.unique(keys & np.uint64(0xFFFF))
    context = keys[3] & ~np.uint64(0xFFFF)
    unseen = m.probability(4, context | np.array([0xFFFF], np.uint64))[0] * ((1 << 12) - len(chars))
    assert abs(m.probability(4, context | chars).sum() + unseen - 1) < 1e-9


def test_quality(spark, data, odd):
    rows = Q.op4_quality_classifier(spark, data).join(common.table(spark, data, "labels"), "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1 and r["held_out"]]
    bad = [r["score"] for r in rows if r["quality"] == 0 and r["held_out"]]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.9
    model = quality_classifier.train(odd, odd.select("doc_id", F.lit(1).alias("quality")).limit(0))
    out = quality_classifier.score(odd, model, odd.columns, ("p", "q")).collect()
    assert len(out) == len(ROWS) and {r["p"] for r in out} == {0.5}
    assert quality_classifier.score(odd.limit(0), model, ["doc_id"]).count() == 0


def test_quality_expression_is_the_model(spark, data):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    model = quality_classifier.train(docs, labels)
    x = quality_classifier.features(docs, ["doc_id"]).toPandas()
    f = x[list(quality_classifier.FEATURES)].to_numpy(float)
    want = 1 / (1 + np.exp(-(model.base + sum(w * quality_classifier.applies(r, f) for r, w in model.rules))))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model, ["doc_id"]).collect()}
    assert np.allclose(want, [got[i] for i in x["doc_id"]])


PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, "http://c", "y" * 50), (4, None, "y" * 50), (5, "u\r\nX: y", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", "x" * 200), (10**15, "u", "<p>\r\n\r\n</p>")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    files = []
    for n in (4, 3):
        path = common.shared_path(spark, "warc-test")
        warc.write_archive(pages.repartition(n), path, roll_bytes=600, range_bytes=400)
        rows = warc.read_archive(spark, path).collect()
        got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=str)
        assert got == sorted([(1, 200, "response", None), (2, 200, "revisit", 1), (3, 50, "response", None), (4, 50, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 120, "response", None), (8, 120, "revisit", 7), (8, 120, "revisit", 7), (None, 200, "revisit", 1), (10**15, 11, "response", None)], key=str)
        files.append(sorted(map(tuple, spark.read.parquet(f"{path}/manifest").collect())))
    assert files[0] == files[1] and len(files[0]) > 2
    empty = common.shared_path(spark, "warc-empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_pipeline(spark, data, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, sizes = common.table(spark, data, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, data), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        sizes.append(docs.count())
    assert len(texts) > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    assert all(naive_pii(r["text"]) == [] for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, common.table(spark, data, "documents").limit(0), data).count() == 0, name
