import pytest
from pyspark.sql import functions as F

from sourcelens.functions import text as T
from sourcelens.functions.query import normalize
from sourcelens.operators import adaptive, graph, index, memory, order, pack, policy, rank, symbols
from sourcelens.plans.context import Engine
from sourcelens.streaming import limiter


def corpus(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/").replace("_rs", ".rs"), v) for k, v in files.items()], "path string, text string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_text(spark):
    x = F.col("x")
    assert one(spark, T.tokens(x), x="auth認証_handler é-x² a") == ["auth認証_handler", "é-x²"]
    assert one(spark, T.fragments(x), x="HTTPServer_ABc-parseX2Value") == ["http", "server", "bc", "parse", "x2", "value"]
    assert one(spark, T.lines(x), x="a\r\nb\n\n") == ["a", "b", ""]
    assert one(spark, T.lines(x), x="") == []
    assert one(spark, T.compact(x), x="a  \n\n\n b\n") == "a\n\n b\n"
    assert one(spark, T.ascii_lower(x), x="ÉA") == "Éa"
    assert one(spark, T.estimated_tokens(x), x="aé") == 2
    assert one(spark, T.first_match(x, ["b", "c"]), x="xCB") == 2
    assert one(spark, T.quoted(x), x="from './auth'") == "./auth"
    assert T.query_grams("abcd") == ["abc", "bcd"] and T.query_grams("ab") == ["ab"] and T.query_grams("éa") == ["a", "é"]


@pytest.mark.parametrize(("path", "reason"), [(".SSH/ID_RSA", "denied"), ("n/.ENV.Production", "denied"), ("Secrets.JSON", "denied"), (".GIT/config", "denied"), (".ENV.Example", None), ("TARGET/debug/x", "pruned"), ("Cargo.LOCK", "pruned"), ("CMAKE-BUILD-Debug/cache.txt", "pruned"), ("assets/logo.png", "binary"), ("lib/archive.JAR", "binary"), ("src/app.rs", None), ("assets/icon.svg", None), (".png", None), ("", "denied")])
def test_policy(spark, path, reason):
    from sourcelens.sources.files import path_reason

    assert policy.with_reason(spark.createDataFrame([(path,)], "path string")).first()["reason"] == reason
    assert path_reason(path) == reason


def test_paths(spark):
    x = F.col("x")
    assert one(spark, policy.normalize_path(x), x="./a//b") == "a/b"
    for bad in ("/a", "a/../b", "a\tb", "."):
        assert one(spark, policy.normalize_path(x), x=bad) is None


def test_phrase_beats_order(spark):
    e = Engine(spark, corpus(spark, a_rs="alpha gamma beta", z_rs="alpha beta gamma"))
    c = e.context("alpha beta")
    assert c.hits[0]["path"] == "z.rs"
    assert "UNTRUSTED" in c.text


def test_path_only_and_empty(spark):
    e = Engine(spark, corpus(spark, src__auth__middleware_rs="pub fn verify_request() -> bool { true }"))
    hit = e.context("middleware gateway").hits
    assert [(h["start_line"], h["end_line"], h["excerpt"], h["score"]) for h in hit] == [(0, 0, "", 3.0)]
    none = Engine(spark, corpus(spark, a_rs="fn alpha() {}")).context("zzzzmissing")
    assert none.hits == [] and none.confidence == pytest.approx(0.98)


def test_withheld(spark):
    secret = "sk-abcdefghijklmnopqrstuvwxyz0123456789"
    hits = Engine(spark, corpus(spark, safe_rs=f'let token = "{secret}";')).context(secret).hits
    assert hits[0]["start_line"] == 0 and secret not in hits[0]["excerpt"]


def test_index(spark):
    c = corpus(spark, a_rs="struct AuthTokenValidator; abc___bcd", b_rs="fn ユーザー認証処理() {}")
    post, sketch = index.postings(c), index.gram_sketch(c)
    assert {r["term"]: r["tf"] for r in post.where("path = 'a.rs'").collect()} == {"struct": 2, "authtokenvalidator": 1, "auth": 1, "token": 1, "validator": 1, "abc___bcd": 1, "abc": 1, "bcd": 1}
    assert [r["path"] for r in index.gram_candidates(sketch, "認証").collect()] == ["b.rs"]
    assert [r["path"] for r in index.gram_candidates(sketch, "abcd").collect()] == ["a.rs"]  # nominated only
    assert rank.scored(c, ["abcd"]).count() == 0
    assert {(r["term"], r["tf"]) for r in index.indexed_frequency(post, sketch, ["token", "認証"]).collect()} == {("token", 1), ("認証", 1)}


def test_saturation(spark):
    got = index.saturated(spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "seq int, path string, n int"), 5)
    assert [r["kept"] for r in got.orderBy("seq").collect()] == [True, False]


def test_delta(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, len int")
    held = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4)], "path string, len int")
    states = index.reconcile(files, held, ["len"])
    assert {r["path"]: r["state"] for r in states.collect()} == {"a": "current", "b": "changed", "c": "missing", "d": "deleted"}
    assert sorted(map(tuple, index.apply_delta(held, states, files).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def naive_best(text, query, terms, limit):
    """The reading of the rules, line by line: (start, end, line, excerpt, exact, structure, score)."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    lines = lines[:-1] if lines[-1] == "" else lines
    best = None
    for i, line in enumerate(lines):
        hits = [low(line).encode().find(t.encode()) for t in terms if t in low(line)]
        if not hits:
            continue
        a, b = max(i - 4, 0), min(i + 5, len(lines))
        while len("\n".join(lines[a:b]).encode()) > limit and b - a > 1:
            left, right = len(lines[a].encode()) if a < i else -1, len(lines[b - 1].encode()) if b > i + 1 else -1
            a, b = (a + 1, b) if left >= right else (a, b - 1)
        cut = "\n".join(lines[a:b])
        if len(cut.encode()) > limit:
            data, room = line.encode(), limit - 24
            inside = lambda p: p < len(data) and 0x80 <= data[p] < 0xC0  # noqa: E731, B023
            s = max(min(hits) - room // 2, 0)
            while inside(s):
                s += 1
            e = min(s + room, len(data))
            while inside(e):
                e -= 1
            if e == len(data) and e - s < room:
                s = max(e - room, 0)
                while inside(s):
                    s += 1
            cut = ("[truncated] " if s else "") + data[s:e].decode() + (" [truncated]" if e < len(data) else "")
        own, exact = low(line.lstrip(" ")), int(query in low(cut))
        structure = 0.0 if not any(t in own for t in terms) else 5.0 if own.startswith(T.DEFINITION_STARTS) else 2.0 if own.startswith(T.IMPORT_STARTS) else 0.0
        score = 25 + 10 * sum(t in low(cut) for t in terms) + 8 * exact + structure
        if best is None or (score, -a) > (best[-1], -best[0] + 1):
            best = (a + 1, b, i + 1, cut, exact, structure, score)
    return best


@pytest.mark.parametrize("limit", [40, 90, 2048])
def test_evidence(spark, limit):
    import random

    rng = random.Random(limit)
    bits = ["alpha", "Beta", "alpha beta", "def ", "use ", "é", "😀", "x" * 30, " ", "-", "\r\n", "\n", "\n", "日本語" * 20]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(150)] + ["alpha", "", "x\n" * 300 + "  def beta()", "é" * 3000 + "alpha" + "é" * 3000, None, "a" * 100 + "\nbeta"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r["path"]): (r["start_line"], r["end_line"], r["line"], r["excerpt"], r["exact"], r["structure"], r["prelim"]) for r in rank.evidence(rows, "alpha beta", ["alpha", "beta"], limit=limit).collect()}
    want = {i: b for i, t in enumerate(texts) if t and (b := naive_best(t, "alpha beta", ["alpha", "beta"], limit))}
    assert got == want and len(got) > 80
    assert all(len(x[3].encode()) <= limit for x in got.values())


def test_huge_neighbour_line(spark):
    """A minified line beside the match doesn't push it out of the hit."""
    hits = Engine(spark, corpus(spark, a_rs="y" * 50_000 + "\nfn alpha() {}\n" + "z" * 50_000)).context("alpha").hits
    assert [(h["start_line"], h["end_line"], h["excerpt"]) for h in hits] == [(2, 2, "fn alpha() {}")]


def test_index_limits(spark):
    c = spark.createDataFrame([("a", "aa bb cc dd"), ("b", "aa")], "path string, text string")
    assert {(r["path"], r["term"], r["truncated"]) for r in index.postings(c, 3).collect()} == {("a", "aa", True), ("a", "bb", True), ("a", "cc", True), ("b", "aa", False)}
    assert index.postings(c).where("truncated").count() == 0 and index.postings(c).count() == 5
    assert {(r["path"], r["truncated"]) for r in index.gram_sketch(c, 2).collect()} == {("a", True), ("b", False)}
    many = spark.createDataFrame([("m", " ".join(f"w{i}" for i in range(40_000)))], "path string, text string")
    assert index.postings(many).count() == 40_000


def test_symbols(spark):
    c = corpus(spark, a_rs="pub fn auth_token() {}\nclass Validator:\nconst fn x\n", py="")
    assert {r["name"]: r["kind"] for r in symbols.heuristic_symbols(c).collect()} == {"auth_token": "function", "Validator": "class", "fn": "constant"}
    facts, refs = symbols.analyse("a.rs", "use crate::auth::Validator;\npub(crate) fn authenticate() { validate_token(x); }\npub struct Session;")
    assert [s[0] for s in facts] == ["authenticate", "Session"] and ("validate_token", "call", 2) in refs
    assert symbols.analyse("a.js", "const authenticate = (token) => token")[0][0][0] == "authenticate"
    assert symbols.analyse("a.py", "class Aa(Bb):\n  def ff(self) -> Cc:\n    gg()\n") == ([("Aa", "class", 1), ("ff", "function", 2)], [("Bb", "implementation", 1), ("Cc", "type", 2), ("gg", "call", 3)])
    files = spark.createDataFrame([("a.rs", "use crate::auth::Validator;"), ("b.ts", "import { x } from './auth/session'"), ("c.py", "from a.b import c\nimport os, sys"), ("d.go", 'import "net/http"')], "path string, text string")
    assert {tuple(r) for r in symbols.import_paths(files).collect()} == {("a.rs", "crate/auth/Validator"), ("b.ts", "//auth/session"), ("c.py", "a/b"), ("c.py", "os"), ("d.go", "net/http")}


def test_call_link(spark):
    e = Engine(spark, corpus(spark, caller_rs="fn handle() { authenticate(); }", auth_rs="pub fn authenticate() -> bool { true }"))
    entries = e.structural_map(e.find(normalize("authenticate")), ["authenticate"], 6)
    links = {p: ls for p, _, _, ls in entries}
    assert [(d, w) for d, _, w in links["caller.rs"]] == [("auth.rs", 0.9)]


def test_pagerank(spark, monkeypatch):
    wanted = [0.25974027943766376, 0.2898465287586195, 0.45041319180371664]
    assert graph.pagerank_small(3, [(0, 1, 0.15), (0, 2, 0.95)]) == pytest.approx(wanted)
    nodes, edges = spark.createDataFrame([(0,), (1,), (2,)], "id bigint"), spark.createDataFrame([(0, 1, 0.15), (0, 2, 0.95)], "src bigint, dst bigint, weight double")
    for limit in (graph.ONE_TASK, 1):
        monkeypatch.setattr(graph, "ONE_TASK", limit)
        assert [r["rank"] for r in graph.pagerank(nodes, edges).orderBy("id").collect()] == pytest.approx(wanted)


def test_memory(spark):
    m = spark.createDataFrame([(1, "s", "a", ["token"], ["src/auth.rs"])], "seq bigint, session_id string, agent_id string, terms array<string>, paths array<string>")
    of = lambda s, a: memory.adjustments(m, ["token"], s, a).first()["adjustment"]
    assert of("s", "a") == pytest.approx(0.55) and of("s", "b") == pytest.approx(-0.9)
    assert memory.adjustments(m, ["token"], "t", "a").count() == 0


def test_memory_age_of_agents_without_session(spark):
    rows = [(1, None, "a", ["t"], ["p"]), (2, None, "b", ["t"], ["p"]), (3, None, "b", ["u"], ["p"])]
    m = spark.createDataFrame(rows, "seq bigint, session_id string, agent_id string, terms array<string>, paths array<string>")
    assert memory.adjustments(m, ["t"], None, "a").first()["adjustment"] == pytest.approx(0.55 / 1.2)


def test_confidence_without_hits(spark):
    none = spark.createDataFrame([], "path string, excerpt string, score double")
    of = lambda cut, n: adaptive.confidence(none, ["a"], F.lit(1), F.lit(1), F.lit(cut), F.lit(n)).first()[0]
    assert (of(True, 0), of(False, 2), of(False, 0)) == (0.05, 0.35, 0.98)


def test_adapt():
    seen = []

    def run(budget):
        seen.append(budget // adaptive.MIB)
        return adaptive.Round(budget, 0.5, len(seen) < 3)

    adaptive.adapt(run)
    assert seen == [32, 64, 128]


def test_round_robin(spark):
    f = spark.createDataFrame([(p,) for p in ("a/1", "a/2", "a/3", "b/1", "c/1")], "path string")
    first = rank.interleaved(f).orderBy("turn", "top").limit(3).collect()
    assert {r["top"] for r in first} == {"a", "b", "c"}


def test_pack():
    e = [pack.Excerpt("a", 1, 2, "x" * 50, 2.0), pack.Excerpt("b", 1, 2, "y" * 500, 1.5), pack.Excerpt("c", 1, 1, "z", 1.0)]
    out = pack.render(e, 1000, 200)
    assert "xxx" in out and "yyy" not in out and "z" in out
    cut = pack.render(e[1:2], 1000, 100)
    assert cut.endswith("[truncated]\n") and len(cut.encode()) <= 100


def test_limiter(spark):
    m = limiter.Limiter()
    assert [m.accept("a", 0) for _ in range(9)] == [True] * 8 + [False]
    assert not m.accept("a", 59.9) and m.accept("a", 60)
    m = limiter.Limiter()
    assert [m.accept(i, 0) for i in range(25)] == [True] * 24 + [False]
    calls = spark.range(9).select("id", F.lit("a").alias("actor"), F.lit(0).cast("timestamp").alias("ts"))
    assert limiter.limit_calls(calls).where("accepted").count() == 8
    assert limiter.limit_all(calls).where("accepted").count() == 8


def test_incomplete_reasons(spark):
    """Failed reads make the scan incomplete, exclusions don't."""
    for reason, whole in (("io", False), ("changed", False), ("not_found", False), ("too_large", False), ("hard_linked", False), ("non_utf8", True), ("denied", True), ("binary", True)):
        rows = [("a.rs", "fn alpha() {}", None), ("b.rs", None, reason)]
        c = Engine(spark, spark.createDataFrame(rows, "path string, text string, reason string")).context("alpha")
        assert c.coverage["complete"] == whole
        assert ("incomplete" in c.text) != whole
    assert "incomplete" in Engine(spark, corpus(spark, a_rs="fn alpha() {}"), truncated=True).context("alpha").text


def test_limits_and_languages(spark):
    from sourcelens.functions import query as Q

    assert [Q.result_limits(n) for n in (1, 2, 4, 5, 8)] == [(8, 6), (16, 12), (16, 12), (24, 16), (24, 16)]
    assert [Q.candidate_limit(k) for k in (1, 8, 16, 24, 32)] == [64, 128, 256, 384, 512]
    assert Q.status(1, False, 0) == "" and "incomplete" in Q.status(1, True, 0) and "excluded" in Q.status(0, False, 1) and Q.status(0, False, 0) == "No match."
    paths = {"a.rs": "rust", "a.pyi": "python", "b.MJS": "javascript", "c.cts": "typescript", "d.tsx": "tsx", "e.go": "go", "f.txt": None, ".rs": None}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", policy.language(F.col("path")).alias("l"))
    assert {r["path"]: r["l"] for r in rows.collect()} == paths
    rng = [(c, e, s, t) for c in (0.0, 0.71, 0.72, 0.88) for e in (3, 4, 8, 17) for s in (6, 12, 17) for t in (1, 7)]
    got = spark.createDataFrame(rng, "c double, e int, s int, t int").select("*", Q.tier_of(F.col("c"), F.col("e"), F.col("s"), F.col("t")).alias("x")).collect()
    assert all(r["x"] == Q.tier(r["c"], r["e"], r["s"], r["t"]) for r in got)


def test_graph_cache():
    c = graph.GraphCache(2)
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3


def test_signature_points(spark):
    """A term that only the definition's line holds moves the symbol up."""
    text = "pub fn first() {}\npub fn second(token: u8) {}\n"
    e = Engine(spark, corpus(spark, a_rs=text))
    assert e.structural_map(e.find(normalize("token")), ["token"], 6)[0][2] == ["function second 2", "function first 1"]


@pytest.mark.parametrize(("line", "want"), [("x Bearer abcdefghij0123456789 y", "x Bearer [REDACTED_CREDENTIAL] y"), ("Basic dXNlcjpwYXNz= z", "Basic [REDACTED_CREDENTIAL] z"), ("Bearer short", "Bearer short"), ("forbearer abcdefghij0123456789", "forbearer abcdefghij0123456789"), ("a bearer aaaaaaaaaaaaaaaa, basic bbbbbbbbbbbb", "a bearer [REDACTED_CREDENTIAL], basic [REDACTED_CREDENTIAL]")])
def test_bare_schemes(spark, line, want):
    from sourcelens.functions import redact

    assert one(spark, redact.by_rule(F.col("x"), "scheme"), x=line) == want


def test_running_over_a_hot_key(spark):
    """Places and sums across ranges: one key holds most rows, others one; null keys are a key."""
    rows = [("hot", (i * 37) % 500, i % 7) for i in range(500)] + [(k, 1, 5) for k in ("a", "b", None)] + [(None, 2, 6)]
    got = order.running(spark.createDataFrame(rows, "k string, o int, n int"), ["k"], ["o"], "place")
    got = order.running(got, ["k"], ["o"], "total", F.col("n")).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted((o, n) for x, o, n in rows if x == k)
        want = [(o, i + 1, sum(n for _, n in own[: i + 1])) for i, (o, _) in enumerate(own)]
        assert sorted((r["o"], r["place"], r["total"]) for r in got if r["k"] == k) == want
    assert order.running(spark.createDataFrame([], "k string, o int"), ["k"], ["o"], "place").count() == 0


def test_running_repeats(spark):
    """Equal rows take different places, and the whole table is one key if there is none."""
    got = order.running(spark.createDataFrame([(1,)] * 40 + [(0,)], "o int"), [], ["o"], "place").collect()
    assert sorted((r["o"], r["place"]) for r in got) == [(0, 1)] + [(1, i) for i in range(2, 42)]


def test_lexical_edges_by_brute_force(spark):
    texts = {"a": "Call_Token here; éé and 𝐱", "b": "token", "c": "", "d": None, "e": "x" * 70_000 + "tail_name", "f": "abctoken_abc"}
    names = [("b", "Token"), ("c", "éé"), ("d", "𝐱"), ("a", "tail_name"), ("f", "abc"), ("e", "token_abc"), ("b", None), ("b", "token"), ("c", "")]
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = graph.lexical_edges(files, spark.createDataFrame(names, "path string, name string")).collect()
    want = {(s, d) for s, t in texts.items() for d, n in names if t and n and s != d and len(n.encode()) >= 4 and n.lower() in t.lower()}
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want) and len(want) >= 6


def test_nearest_reference_edges(spark):
    """Links of each file are the same whether or not edges of common names are all made; a name that all files
    define makes no more edges than seven a file."""
    import random

    rng = random.Random(2)
    refs = spark.createDataFrame([(f"f{rng.randrange(40):02d}", f"N{rng.randrange(6)}", rng.choice(["call", "type", "reference"])) for _ in range(300)], "path string, name string, kind string")
    defs = spark.createDataFrame([(f"f{i:02d}", f"n{rng.randrange(6)}") for i in range(40)] + [(f"f{i:02d}", "n0") for i in range(40)], "path string, name string")
    links = lambda e: sorted(map(tuple, graph.links(graph.best_edges(e)).select("src", "dst", "weight", "rank").collect()))
    assert links(graph.nearest_reference_edges(refs, defs)) == links(graph.reference_edges(refs, defs))
    shared = spark.range(100_000).select(F.format_string("f%06d", "id").alias("path"), F.lit("new").alias("name"), F.lit("call").alias("kind"))
    assert graph.nearest_reference_edges(shared, shared).count() == 7 * 100_000 - 7


def test_many_names_in_a_text(spark, monkeypatch):
    monkeypatch.setattr(graph, "NAMES_TOGETHER", 3)
    names = [f"name{i:02d}" for i in range(20)]
    files = spark.createDataFrame([("all", " ".join(names)), ("few", "name03 name04")] + [(n, "x") for n in names], "path string, text string")
    got = {(r["src"], r["dst"]) for r in graph.lexical_edges(files, spark.createDataFrame([(n, n) for n in names], "path string, name string")).collect()}
    assert got == {("all", n) for n in names} | {("few", "name03"), ("few", "name04")}


def test_limits_say_what_they_cut(spark):
    files = spark.createDataFrame([("a.rs", "fn one() {}\nfn two() {}\nuse a::b;\nuse c;\n"), ("b.rs", "fn one() {}\n")], "path string, text string")
    for found, most in ((symbols.heuristic_symbols, 1), (symbols.import_paths, 1)):
        assert "truncated" not in found(files).columns
        assert {r["path"]: r["truncated"] for r in found(files, most).collect() if r["path"] == "a.rs"} == {"a.rs": True}
    cut = symbols.syntax_facts(files, 1, 0).collect()
    assert [(r["path"], r["name"], r["truncated"]) for r in cut] == [("a.rs", "one", True), ("b.rs", "one", False)]
    both = symbols.combined_symbols(symbols.syntax_facts(files).where("fact = 'symbol'"), symbols.heuristic_symbols(files), 1)
    assert {r["path"]: r["truncated"] for r in both.collect()} == {"a.rs": True, "b.rs": False}
    scored = spark.createDataFrame([(f"p{i}", float(i)) for i in range(5)], "path string, score double")
    assert [(r["path"], r["beyond"]) for r in rank.cut(scored, 2).orderBy("path").collect()] == [("p3", True), ("p4", True)]
    assert not any(r["beyond"] for r in rank.cut(scored, 5).collect())


def test_two_calls_at_once(spark):
    """Answers, memory and texts of overlapping calls are their own."""
    import threading

    files = {f"m{i}.rs": f"fn alpha{i}() {{ shared(); }}\nfn beta{i}() {{}}\n" for i in range(12)}
    e = Engine(spark, spark.createDataFrame(list(files.items()), "path string, text string"))
    alone = {q: Engine(spark, e.corpus).context(q).text for q in ("alpha1 shared", "beta2 alpha2", "alpha3 beta3")}
    got, errors = {}, []

    def ask(q):
        try:
            got[q] = e.context(q, agent_id=q.split()[0]).text
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=ask, args=(q,)) for q in alone]
    [t.start() for t in threads], [t.join(300) for t in threads]
    assert not errors and e.seq == 3 and sorted(r[0] for r in e.records) == [1, 2, 3]
    heads = lambda t: [x for x in t.split("\n") if x.startswith(('"', "CONTEXT", "COVERAGE"))]
    assert all({h.split(" score ")[0] for h in heads(got[q])} == {h.split(" score ")[0] for h in heads(alone[q])} for q in alone)
