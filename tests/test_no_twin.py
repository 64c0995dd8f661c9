"""Queries without a SQL twin, held against plain readings of the rules over the whole table."""

import hashlib
import math
import re

import pytest

from sourcelens import queries as Q
from sourcelens.functions import query as query_module
from sourcelens.operators.corpus import table
from tests.test_operators import naive_best

LITERAL = re.compile('token = "[0-9a-f]{40}"')
HELD = {"redact_full", "syntax_facts", "rate_limiter", "rate_limiter_overall", "repo_context", "indexed_context"}


def test_every_query_is_held_against_something():
    assert set(Q.queries()) - set(Q.oracle_sql()) == HELD


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r for r in table(spark, data, "documents").collect()}


def safe(text):
    """The table's only secrets are such literals."""
    return LITERAL.sub('token = "[REDACTED_LITERAL]"', text)


def test_redact_full(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest that holds literals
    texts = {r["doc_id"]: r for r in table(spark, data, "documents").collect()}
    rows = Q.queries()["redact_full"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    head = "password:\n  [REDACTED_MULTILINE_LITERAL]\n[REDACTED_PRIVATE_KEY]\n\n\nCookie: [REDACTED_COOKIE]\n"
    for r in rows:
        assert r["redacted"] == head + safe(texts[r["doc_id"]]["text"])
        assert hashlib.md5(str(r["doc_id"]).encode()).hexdigest() not in r["redacted"]
    assert any(LITERAL.search(t["text"]) for t in texts.values())


def test_syntax_facts(spark, data):
    rows = Q.queries()["syntax_facts"](spark, data).collect()
    want = set()
    for p in table(spark, data, "part").select("p_partkey", "p_size").collect():
        k, path = p["p_partkey"], f"src/p{p['p_partkey']}.rs"
        want |= {(path, "symbol", f"part_{k}", "function", 2), (path, "symbol", f"Kind{p['p_size']}", "struct", 5), (path, "symbol", "fn", "constant", 6)}
        want |= {(path, "reference", f"p{k % 50}", "reference", 1), (path, "reference", "Item", "reference", 1), (path, "reference", f"part_{k % 97 + 1}", "call", 3)}
    assert {(r["path"], r["fact"], r["name"], r["kind"], r["line"]) for r in rows} == want and len(rows) == len(want)


def test_rate_limiters(spark, data):
    calls = sorted((r["ts"].timestamp(), r["event_id"], r["event_type"]) for r in table(spark, data, "events").select("ts", "event_id", "event_type").collect())
    for name, most in (("rate_limiter", math.inf), ("rate_limiter_overall", 24)):
        held, want = [], {}
        for t, i, actor in calls:
            held = [(s, a) for s, a in held if t - s < 3600]
            want[i] = len(held) < most and sum(a == actor for _, a in held) < 8
            held += [(t, actor)] if want[i] else []
        got = {r["id"]: r["accepted"] for r in Q.queries()[name](spark, data).collect()}
        assert got == want and 0 < sum(got.values())


def test_repo_context(spark, data, texts):
    """Statistics, BM25, scores, evidence and the order of hits, document by document."""
    terms, docs = Q.TERMS, {}
    for r in texts.values():
        low = r["text"].translate({c: c + 32 for c in range(65, 91)})
        tokens = [t for t in re.findall(r"[\w-]+", low) if len(t.encode()) >= 2]
        tf = [max(tokens.count(t), 1) if t in low else 0 for t in terms]
        docs[f"{r['source']}/{r['lang']}/{r['doc_id']}.txt"] = r["text"], max(len(tokens), 1), tf
    n, mean = len(docs), sum(d[1] for d in docs.values()) / len(docs)
    df = [sum(d[2][i] > 0 for d in docs.values()) for i in range(len(terms))]
    scored = []
    for path, (text, dl, tf) in docs.items():
        bm25 = sum(math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl / mean)) for i, x in enumerate(tf) if x)
        bonus = sum(t in path for t in terms)
        if any(tf):
            scored.append((25 + 10 * sum(x > 0 for x in tf) + 3 * bonus + 12 * bm25, path, text))
        elif bonus:
            scored.append((3.0 * bonus, path, None))
    k = query_module.result_limits(len(terms))[0]
    hits = []
    for score, path, text in sorted(scored, key=lambda x: (-x[0], x[1]))[: query_module.candidate_limit(k)]:
        best = naive_best(safe(text), Q.QUERY, terms, 2048) if text else None
        if best:
            hits.append((score + 8 * best[4] + best[5], path, best[0], best[1]))
        else:
            hits.append((score, path, 0, 0))
    want = sorted(hits, key=lambda h: (-h[0], h[1], h[2]))[:k]
    got = Q.queries()["repo_context"](spark, data).orderBy("place").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [h[1:] for h in want]
    assert [r["score"] for r in got] == pytest.approx([h[0] for h in want])
    assert got[0]["pack"].startswith("[UNTRUSTED") and all(r["pack"] is None for r in got[1:])
    shown = [h[1] for h in want if f'"{h[1]}" lines {h[2]}-{h[3]} score' in got[0]["pack"]]
    assert shown and shown[0] == want[0][1]


def test_indexed_context(spark, data, texts):
    """By the index: a term's frequency is that of tokens and their fragments, or 1 where all its grams occur.
    These give the candidates and the documents' frequencies; verified hits count by the text itself."""
    terms, docs = Q.TERMS, {}
    lower = {c: c + 32 for c in range(65, 91)}
    for r in texts.values():
        low = r["text"].translate(lower)
        found = [t for t in re.findall(r"[\w-]+", r["text"]) if len(t.encode()) >= 2]
        parts = [f.translate(lower) for t in found for f in re.split(r"[_-]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", t) if len(f.encode()) >= 2]
        counted = [t.translate(lower) for t in found] + parts
        grams = {run[i : i + k] for run in re.findall("[a-z0-9_-]+", low) if len(run) >= 2 for k in (2, 3) for i in range(len(run) - k + 1)}
        tokens = [t.translate(lower) for t in found]
        index = [max(counted.count(t), int(all(t[i : i + min(3, len(t))] in grams for i in range(max(len(t) - 2, 1))))) for t in terms]
        tf = [max(tokens.count(t), 1) if t in low else 0 for t in terms]
        docs[f"{r['source']}/{r['lang']}/{r['doc_id']}.txt"] = r["text"], max(len(tokens), 1), index, tf
    n, mean = len(docs), sum(d[1] for d in docs.values()) / len(docs)
    df = [sum(d[2][i] > 0 for d in docs.values()) for i in range(len(terms))]

    def score(dl, tf, bonus):
        bm25 = sum(math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl / mean)) for i, x in enumerate(tf) if x)
        return 25 + 10 * sum(x > 0 for x in tf) + 3 * bonus + 12 * bm25

    ranked = []
    for path, (_, dl, index, _) in docs.items():
        bonus = sum(t in path for t in terms)
        if any(index) or bonus:
            ranked.append((score(dl, index, bonus) if any(index) else 3.0 * bonus, path, bonus, any(index)))
    k = query_module.result_limits(len(terms))[0]
    hits = []
    for own, path, bonus, content in sorted(ranked, key=lambda x: (-x[0], x[1]))[: query_module.candidate_limit(k)]:
        text, dl, _, tf = docs[path]
        best = naive_best(safe(text), Q.QUERY, terms, 2048) if content and any(tf) else None
        if best:
            hits.append((score(dl, tf, bonus) + 8 * best[4] + best[5], path, best[0], best[1]))
        elif content and any(tf):
            hits.append((score(dl, tf, bonus), path, 0, 0))
        elif bonus:
            hits.append((own if not content else 3.0 * bonus, path, 0, 0))
    want = sorted(hits, key=lambda h: (-h[0], h[1], h[2]))[:k]
    got = Q.queries()["indexed_context"](spark, data).orderBy("place").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [h[1:] for h in want]
    assert [r["score"] for r in got] == pytest.approx([h[0] for h in want]) and all(r["indexed"] == n for r in got)
