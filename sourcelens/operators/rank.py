"""Scores, candidates and evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from . import order

K1, B = 1.2, 0.75
CONTENT_BASE = 25
CONTEXT, EXCERPT_BYTES = 4, 2048
WITHHELD = "[REDACTED_MATCH]"
CUT_BEFORE, CUT_AFTER = "[truncated] ", " [truncated]"


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def term_statistics(corpus: DataFrame, terms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """path, dl, tf0..: how often each term is a whole token, or 1 if it is part of the text only. Nothing
    is exploded or shuffled; each text is split once."""
    low = T.ascii_lower(F.col("text"))
    d = corpus.select("path", *keep, low.alias("_low"), T.tokens(low).alias("_tokens"))
    return d.select("path", *keep, F.greatest(F.size("_tokens"), F.lit(1)).cast("bigint").alias("dl"), *(_tf(t).alias(f"tf{i}") for i, t in enumerate(terms)))


def _tf(term: str) -> Column:
    whole = F.size(F.filter("_tokens", lambda x: x == term))
    return F.when(~F.contains("_low", F.lit(term)), 0).otherwise(F.greatest(whole, F.lit(1))).cast("bigint")


def corpus_row(stats: DataFrame, n_terms: int) -> DataFrame:
    """One row: n_docs, avgdl, and df0.. of each term."""
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n_terms)))


def bm25(n_terms: int) -> Column:
    """Over columns dl, tf0.., n_docs, avgdl, df0..; 0 for an empty corpus."""

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return F.when((F.col("n_docs") > 0) & (F.col("avgdl") > 0), add([part(i) for i in range(n_terms)])).otherwise(0.0)


def matched(n_terms: int) -> Column:
    return add([F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(n_terms)])


def path_score(path: Column, terms: list[str]) -> Column:
    return T.count_contained(T.ascii_lower(path), terms)


def with_scores(rows: DataFrame, terms: list[str], memory: Column | None = None) -> DataFrame:
    """rows (path, dl, tf.., n_docs, avgdl, df..) with matched, path_bonus, bm25 and score; others than
    matches of the content or the path go."""
    n, m = len(terms), F.lit(0.0) if memory is None else memory
    j = rows.withColumns({"bm25": bm25(n), "matched": matched(n), "path_bonus": path_score(F.col("path"), terms)})
    content = CONTENT_BASE + 10 * F.col("matched") + 3 * F.col("path_bonus") + 12 * F.col("bm25") + m
    score = F.when(F.col("matched") > 0, content).when(F.col("path_bonus") > 0, 3 * F.col("path_bonus") + F.least(m, F.lit(4.0)))
    return j.withColumn("score", score).where("score is not null")


def matches(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of term_statistics that match by content or path, with the corpus statistics (n_docs,
    avgdl, df..), in one pass over the texts: the statistics of all documents are observed while the
    matching rows, numbers only, are stored."""
    n, seen = len(terms), Observation()
    stats = term_statistics(corpus, terms).observe(seen, F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)))
    kept = stored(stats.where((matched(n) > 0) | (path_score(F.col("path"), terms) > 0)), "matches")
    known = seen.get
    return kept.withColumns({k: F.lit(known[k] if known[k] is not None else 1.0) for k in ("n_docs", "avgdl", *(f"df{i}" for i in range(n)))})


def scored(corpus: DataFrame, terms: list[str], memory: Column | None = None) -> DataFrame:
    """path, dl, tf.., matched, path_bonus, bm25, score: content matches and matches of the path only."""
    return with_scores(matches(corpus, terms), terms, memory)


def top(df: DataFrame, k: int, *more: str) -> DataFrame:
    """The k best rows by score, then path and the other columns: a bounded sort in each task."""
    return df.orderBy(F.desc("score"), "path", *more).limit(k)


def cut(df: DataFrame, limit: int) -> DataFrame:
    """The `limit` best rows as `top` orders them, each with beyond: whether there are more. One row more than
    the limit is looked at, in one task."""
    one_more = top(df, limit + 1).withColumn("_place", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    return one_more.withColumn("beyond", F.max("_place").over(Window.partitionBy()) > limit).where(F.col("_place") <= limit).drop("_place")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def focus_cut(line: Column, match: Column, limit: int = EXCERPT_BYTES) -> Column:
    """line, cut to `limit` bytes around byte `match` where it is longer: whole characters, marks at cut ends."""
    room = limit - len(CUT_BEFORE) - len(CUT_AFTER)
    data = F.encode(line, "utf-8")
    inner = lambda p: F.hex(F.substring(data, p + 1, F.lit(1))).between("80", "BF")
    up = lambda p: p + F.when(~inner(p), 0).when(~inner(p + 1), 1).when(~inner(p + 2), 2).otherwise(3)
    down = lambda p: p - F.when(~inner(p), 0).when(~inner(p - 1), 1).when(~inner(p - 2), 2).otherwise(3)
    size = F.octet_length(line)
    text = lambda s, e: F.concat(F.when(s > 0, CUT_BEFORE).otherwise(""), F.decode(F.substring(data, s + 1, e - s), "utf-8"), F.when(e < size, CUT_AFTER).otherwise(""))
    start = lambda s, e: F.when((e == size) & (e - s < room), up(F.greatest(e - room, F.lit(0)))).otherwise(s)
    cut = bound(up(F.greatest(match - room // 2, F.lit(0))), lambda s: bound(down(F.least(s + room, size)), lambda e: bound(start(s, e), lambda s: text(s, e))))
    return F.when(size <= limit, line).otherwise(cut)


def frame(lines: Column, i: Column, limit: int = EXCERPT_BYTES) -> Column:
    """The struct (a, b, size) of the lines around line i (from 1) and their bytes. While they are more than
    `limit` bytes, the larger outer line goes, the left one on a tie."""
    of = lambda k: F.octet_length(F.element_at(lines, k))
    a, b = F.greatest(i - CONTEXT, F.lit(1)), F.least(i + CONTEXT, F.size(lines))
    first = F.struct(a.alias("a"), b.alias("b"), F.octet_length(F.array_join(F.slice(lines, a, b - a + 1), "\n")).alias("size"))

    def step(f: Column, _: Column) -> Column:
        left, right = F.when(f["a"] < i, of(f["a"])).otherwise(-1), F.when(f["b"] > i, of(f["b"])).otherwise(-1)
        out = F.when(left >= right, F.struct((f["a"] + 1).alias("a"), f["b"].alias("b"), (f["size"] - left - 1).alias("size")))
        return F.when((f["size"] <= limit) | (f["a"] == f["b"]), f).otherwise(out.otherwise(F.struct(f["a"].alias("a"), (f["b"] - 1).alias("b"), (f["size"] - right - 1).alias("size"))))

    return bound(first, lambda f: F.when(f["size"] <= limit, f).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(2 * CONTEXT)), f, step)))


def evidence(corpus: DataFrame, query: str, terms: list[str], keep: tuple[str, ...] = (), limit: int = EXCERPT_BYTES) -> DataFrame:
    """path, keep, start_line, end_line, line, excerpt, exact, structure, prelim: of each document that holds
    a term, the line that holds one and whose excerpt scores best. The excerpt is the line with four lines
    around it, bound to `limit` bytes before it is scored: outer lines go first, then the line is cut around
    its first match.

    Lines are split once and bound as a variable of one expression, so that the optimizer can't put the
    split into the loops over lines. Nothing is shuffled and no line table is made.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = lambda ls, f: F.array_join(F.slice(ls, f["a"], f["b"] - f["a"] + 1), "\n")
    match = lambda low: F.array_min(F.array(*(F.when(F.contains(low, F.lit(t)), F.octet_length(F.substring_index(low, t, 1))) for t in terms), F.octet_length(low)))

    def excerpt(ls: Column, low: Column, i: Column, f: Column) -> Column:
        return F.when(f["size"] <= limit, joined(ls, f)).otherwise(focus_cut(F.element_at(ls, i), match(F.element_at(low, i)), limit))

    def judged(low: Column, i: Column) -> Column:
        def scored(f: Column) -> Column:
            def rated(x: Column) -> Column:
                exact, structure = F.contains(x, F.lit(query)).cast("int"), T.structural_bonus_lower(F.element_at(low, i), terms)
                prelim = CONTENT_BASE + 10 * T.count_contained(x, terms) + 8 * exact + 3 * F.col("_bonus") + structure
                return F.struct((-prelim).alias("order"), f["a"].alias("start_line"), i.alias("line"), f["b"].alias("end_line"), exact.alias("exact"), structure.alias("structure"), f["size"].alias("size"))

            return bound(excerpt(low, low, i, f), rated)

        return bound(frame(low, i, limit), scored)

    def best(s: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(s["low"])), lambda i: T.contains_any(F.element_at(s["low"], i), terms))
        found = F.array_min(F.transform(hits, lambda i: judged(s["low"], i)))
        shown = lambda e: excerpt(s["ls"], s["low"], e["line"], F.struct(e["start_line"].alias("a"), e["end_line"].alias("b"), e["size"].alias("size")))
        return bound(found, lambda e: F.struct(e["start_line"].alias("start_line"), e["end_line"].alias("end_line"), e["line"].alias("line"), shown(e).alias("excerpt"), e["exact"].alias("exact"), e["structure"].alias("structure"), (-e["order"]).alias("prelim")))

    # A term holds no line end, so a text that contains one has a line that does.
    d = corpus.where(T.contains_any(T.ascii_lower(F.col("text")), terms)).withColumn("_bonus", path_score(F.col("path"), terms))
    both = F.struct(T.lines(text).alias("ls"), T.lines(T.ascii_lower(text)).alias("low"))
    return d.select("path", *keep, bound(both, best).alias("e")).select("path", *keep, "e.*")


def interleaved(files: DataFrame) -> DataFrame:
    """files with top (the first path component), turn and the order of a round over the components."""
    top_dir = F.split("path", "/")[0]
    return order.running(files.withColumn("top", top_dir), ["top"], ["path"], "turn")


def path_only(files: DataFrame, indexed: DataFrame, terms: list[str]) -> DataFrame:
    """Files that aren't indexed but whose path holds a term: path, path_bonus, score."""
    rest = files.join(indexed.select("path"), "path", "left_anti").withColumn("path_bonus", path_score(F.col("path"), terms))
    return rest.where("path_bonus > 0").select("path", "path_bonus", (3.0 * F.col("path_bonus")).alias("score"))


def candidates(scored: DataFrame, by_path: DataFrame) -> DataFrame:
    """path, path_bonus, score of what may be shown: matches among indexed files, and path matches elsewhere."""
    columns = ["path", "path_bonus", "score"]
    return scored.select(columns).unionByName(by_path.select(columns))


def revalidated(hits: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (path, fingerprint) whose source still has the fingerprint, and the paths of the others."""
    now = fresh.select("path", F.col("fingerprint").alias("_now"))
    j = hits.join(now, "path", "left")
    same = F.col("fingerprint").eqNullSafe(F.col("_now"))
    return j.where(same).drop("_now"), j.where(~same).select("path")
