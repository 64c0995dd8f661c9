"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each metric is sketched for each language and source as counts over buckets whose width is 1/64 of the
value or less (a relative-error quantile sketch). Sketches merge by adding counts: the ones of sources
merge into their language's, and those into one of all. Every threshold is read off the sketches, and
documents are filtered by joining them.

A fence lies REACH interdecile ranges above the upper decile (a low one likewise below the lower decile).
Most documents have no symbol and no repeat at all, so that range is often 0; the fence then still leaves room for one event in a short document of the group: one symbol, one
repeated line, one repeated window, as a share of the lower decile of the group's own sizes, which are
sketched as the metrics are. No metric has a cutoff of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, materialize

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"
#: A source of fewer documents takes its language's thresholds, and a language of fewer those of all.
MIN_DOCS = 100
REACH = 2
#: Metric: the size it is a share of, how much of that one event takes up (a window's first repeat: five words
#: twice), and whether low values count against a document too.
METRICS = {"symbol_pm": ("word_chars", 1, False), "dup_line_pm": ("n_lines", 1, False), "repeat_pm": ("n_words", 10, False), "word_len10": (None, 0, True)}
SIZES = ("word_chars", "n_lines", "n_words")


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row (see op2's contract); null text: no words.

    Windows of five words are compared by hash first; only in texts with two equal hashes are the windows
    themselves sorted and compared, so the counts are exact. Nothing leaves its row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = F.trim(F.translate("t", GAPS[1:], " " * (len(GAPS) - 1)))
    d = docs.select("doc_id", "lang", "source", text.alias("t")).withColumn("flat", flat)
    d = d.select(
        "doc_id", "lang", "source",
        F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " +")).alias("words"),
        F.length(F.translate("t", GAPS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, GAPS, "") != "").alias("lines"),
    )
    n = F.size("words")
    d = d.withColumn("h", F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))))
    some = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    window = lambda i: F.struct(F.array_join(F.slice("words", i, 5), " ").alias("s"), i.alias("i"))
    d = d.withColumn("sorted", F.when(some, F.sort_array(F.transform(F.sequence(F.lit(1), n - 4), window))))
    at = lambda k: F.try_element_at("sorted", k)["s"]
    twice = F.transform("sorted", lambda x, k: F.when((at(k + 2) == x["s"]) | ((k > 0) & (F.col("sorted")[F.greatest(k - 1, F.lit(0))]["s"] == x["s"])), x["i"]))
    d = d.withColumn("at", F.sort_array(F.filter(twice, lambda x: x.isNotNull())))
    last = F.size("at") - 1
    covered = F.aggregate(F.transform("at", lambda p, k: F.when(k == last, F.lit(5)).otherwise(F.least(F.lit(5), F.col("at")[F.least(k + 1, last)] - p))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id", "lang", "source", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def with_metrics(stats: DataFrame) -> DataFrame:
    share = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return stats.select(
        "*",
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        share("n_symbols", "word_chars", 1000).alias("symbol_pm"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_line_pm"),
        share("n_repeat_words", "n_words", 1000).alias("repeat_pm"),
        share("word_chars", "n_words", 10).alias("word_len10"),
    )


def bucket(x: Column) -> Column:
    """The least value of x's bucket: x itself below 128, and above that its first seven binary digits."""
    shift = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("bigint")
    return x - F.pmod(x, width)


def bucket_width(low: Column) -> Column:
    """How many values the bucket holds whose least value is given."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(low)) - 7, F.lit(0))).cast("bigint")


def quantile_sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, level (0 source, 1 language, 3 all), metric, value, n: the sketches of the metrics and
    sizes of documents that pass the base rules. At most some 4000 rows a group and metric, whatever the
    number of documents."""
    names = [*METRICS, *SIZES]
    each = metrics.where(~F.col("base_failed")).select("lang", "source", F.explode(F.create_map(*(x for m in names for x in (F.lit(m), bucket(F.col(m)))))).alias("metric", "value"))
    fine = each.groupBy("lang", "source", "metric", "value").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("lang", "metric", "value").agg(F.sum("n").alias("n"))
    every = coarse.groupBy("metric", "value").agg(F.sum("n").alias("n"))
    out = ["lang", "source", "level", "metric", "value", "n"]
    fine, coarse = fine.withColumn("level", F.lit(0)), coarse.withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)})
    return fine.select(out).union(coarse.select(out)).union(every.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(3)}).select(out))


def fences(sketches: DataFrame) -> DataFrame:
    """lang, source, level, docs and, for each metric, <metric>_low and <metric>_high."""
    group = ["level", "lang", "source", "metric"]
    cum = sketches.withColumn("cum", F.sum("n").over(Window.partitionBy(group).orderBy("value"))).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    tenths = lambda k: F.min(F.when(F.col("cum") * 10 >= F.col("all") * k, F.col("value")))
    q = cum.groupBy(group).agg(F.max("all").alias("docs"), *(tenths(k).alias(f"q{k}") for k in (1, 9)))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *(of(m, f"q{k}").alias(f"{m}_q{k}") for m in (*METRICS, *SIZES) for k in (1, 9)))

    def bounds(m: str, size: str | None, event: int) -> list[Column]:
        low, high = F.col(f"{m}_q1"), F.col(f"{m}_q9")
        room = F.expr(f"{1000 * event} div greatest({size}_q1, 1)") if size else F.lit(0)
        return [(low - REACH * (high - low) - bucket_width(low)).alias(f"{m}_low"), (high + REACH * (high - low) + bucket_width(high) + room).alias(f"{m}_high")]

    return wide.select("level", "lang", "source", "docs", *(c for m, (size, event, _) in METRICS.items() for c in bounds(m, size, event)))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each row of docs (doc_id, lang, source, text) with base_failed and kept.

    kept is false if the base rules fail or a metric lies outside its fences: those of its (lang, source)
    if they rest on MIN_DOCS documents, else its language's, else those of all. Null lang and source are
    groups of their own. Repeated rows count each. With no document that passes the base rules there are no
    fences, and nothing else is dropped. The text is read once; the statistics are a stored table.
    """
    stats = materialize(with_metrics(document_stats(docs)), "quality-stats")
    fence = materialize(fences(quantile_sketches(stats)), "quality-fences")
    bounds = [f"{m}_{s}" for m in METRICS for s in ("low", "high")]
    own = fence.where("level = 0").select(F.col("lang").alias("fl"), F.col("source").alias("fs"), F.col("docs").alias("d0"), *(F.col(b).alias(f"{b}0") for b in bounds))
    lang = fence.where("level = 1").select(F.col("lang").alias("gl"), F.col("docs").alias("d1"), *(F.col(b).alias(f"{b}1") for b in bounds))
    every = fence.where("level = 3").select(*(F.col(b).alias(f"{b}3") for b in bounds))
    j = stats.join(own, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
    j = j.join(lang, F.col("lang").eqNullSafe(F.col("gl")), "left")
    # One row at most.
    j = j.join(F.broadcast(every), F.lit(True), "left")
    pick = lambda b: F.when(F.col("d0") >= MIN_DOCS, F.col(f"{b}0")).when(F.col("d1") >= MIN_DOCS, F.col(f"{b}1")).otherwise(F.col(f"{b}3"))
    out = F.lit(False)
    for m, (_, _, low_too) in METRICS.items():
        out = out | F.coalesce(F.col(m) > pick(f"{m}_high"), F.lit(False))
        if low_too:
            out = out | F.coalesce(F.col(m) < pick(f"{m}_low"), F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~out).alias("kept"))


#: The same in DuckDB's SQL: words and windows as rows, thresholds from the same buckets.
SQL = f"""
with d as (select doc_id, lang, source, coalesce(text, '') t from documents),
w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) p from (select doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws from d)),
g as (select *, lead(w, 1) over o w1, lead(w, 2) over o w2, lead(w, 3) over o w3, lead(w, 4) over o w4 from w window o as (partition by doc_id order by p)),
c as (select doc_id, p, w4 is not null and count(*) over (partition by doc_id, w, w1, w2, w3, w4) > 1 twice from g),
r as (select doc_id, count(*) n_words, count(*) filter (hit) n_repeat_words from (select doc_id, bool_or(twice) over (partition by doc_id order by p rows between 4 preceding and current row) hit from c) group by doc_id),
l as (select doc_id, count(*) n_lines, count(*) - count(distinct l) n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
s as (select doc_id, lang, source, coalesce(n_words, 0)::bigint n_words, length(regexp_replace(t, '{WORD_GAP}', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words
    from d left join r using (doc_id) left join l using (doc_id)),
m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, 1000 * n_symbols // greatest(word_chars, 1) symbol_pm, 1000 * n_dup_lines // greatest(n_lines, 1) dup_line_pm,
    1000 * n_repeat_words // greatest(n_words, 1) repeat_pm, 10 * word_chars // greatest(n_words, 1) word_len10 from s),
e as (select doc_id, lang, source, unnest({[*METRICS, *SIZES]}) metric, unnest([{", ".join([*METRICS, *SIZES])}]) x from m where not base_failed),
b as (select lang, source, metric, x - x % (1 << greatest(length(bin(x)) - 7, 0))::bigint v from e),
k as (select 0 level, lang, source, metric, v, count(*) n from b group by all union all select 1, lang, null, metric, v, count(*) from b group by all union all select 3, null, null, metric, v, count(*) from b group by all),
q as (select level, lang, source, metric, max(a) docs, min(v) filter (10 * cum >= a) q1, min(v) filter (10 * cum >= 9 * a) q9 from
    (select *, sum(n) over (partition by level, lang, source, metric order by v) cum, sum(n) over (partition by level, lang, source, metric) a from k) group by all),
f as (select q.level, q.lang, q.source, q.metric, q.docs, q.q1 - {REACH} * (q.q9 - q.q1) - (1 << greatest(length(bin(q.q1)) - 7, 0))::bigint low,
    q.q9 + {REACH} * (q.q9 - q.q1) + (1 << greatest(length(bin(q.q9)) - 7, 0))::bigint + coalesce(1000 * event // greatest(z.q1, 1), 0) high, low_too
    from q join (values {", ".join(f"('{m}', '{s}', {e}, {t})" for m, (s, e, t) in METRICS.items())}) r (metric, size, event, low_too) on r.metric = q.metric
    left join q z on z.metric = r.size and z.level = q.level and z.lang is not distinct from q.lang and z.source is not distinct from q.source),
x as (select e.doc_id, bool_or(e.x > h or low_too and e.x < lo) fenced from (
    select e.doc_id, e.metric, e.x, f3.low_too, case when f0.docs >= {MIN_DOCS} then f0.high when f1.docs >= {MIN_DOCS} then f1.high else f3.high end h,
        case when f0.docs >= {MIN_DOCS} then f0.low when f1.docs >= {MIN_DOCS} then f1.low else f3.low end lo
    from e left join f f0 on f0.level = 0 and f0.metric = e.metric and f0.lang is not distinct from e.lang and f0.source is not distinct from e.source
    left join f f1 on f1.level = 1 and f1.metric = e.metric and f1.lang is not distinct from e.lang
    left join f f3 on f3.level = 3 and f3.metric = e.metric) e group by e.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(fenced, false) kept from m left join x using (doc_id)
"""
