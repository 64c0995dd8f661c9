"""Site-relative line dedup: a line goes where more than a given share of its site's pages contain it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: A line is boilerplate if more than RATIO of its host's pages contain it, and at least MIN_PAGES do.
RATIO, MIN_PAGES = 0.08, 3
#: Hashes in a bucket of a host's line set, about.
SLOT = 4


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, pages (its rows), lines array<array<bigint>>: hashes of the host's boilerplate lines, dealt into
    buckets by their remainder, so that a look-up reads about SLOT hashes.

    A page is a row of docs, counted once for each different line with visible characters. Pages of a null
    host form a group of their own. The lines of a host are at most its mean number of lines a page
    divided by `ratio`, so each array is bounded. Counts are summed before the shuffle, so a hot host or
    line costs one row a task.
    """
    page = docs.select(F.col(host).alias("host"), F.array_distinct(F.split(F.col(text).cast("string"), "\n", -1)).alias("ls"))
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    line = page.select("host", F.explode("ls").alias("l")).where(F.trim("l") != "").select("host", F.xxhash64("l").alias("l"), F.xxhash64(F.lit("line"), "l").alias("check"))
    counted = line.groupBy("host", "l", "check").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    # The few sites' totals meet counts, not texts.
    same = lambda df: df.select(F.col("host").alias("h"), *(c for c in df.columns if c != "host"))
    kept = counted.join(same(pages), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages")).select("host", "pages", "l")
    kept = materialize(kept.distinct(), "boilerplate-lines")
    sized = kept.groupBy("host").agg(F.first("pages").alias("pages"), F.expr(f"cast(greatest(1, count(*) div {SLOT}) as int)").alias("slots"))
    # A row with no line for each bucket, so that none is missing and each stands at its number.
    every = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).withColumn("l", F.lit(None).cast("bigint"))
    own = kept.select("host", "l").join(same(sized), F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("slot", slot("l", "slots"))
    dealt = own.unionByName(every).groupBy("host", "pages", "slot").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    listed = dealt.groupBy("host", "pages").agg(F.sort_array(F.collect_list(F.struct("slot", "ls"))).alias("x"))
    return listed.select("host", "pages", F.transform("x", lambda b: b["ls"]).alias("lines"))


def slot(line: str | Column, slots: str | Column) -> Column:
    return F.pmod(line, F.col(slots) if isinstance(slots, str) else slots).cast("int")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of `text`; every column and row stays, and n_lines and
    n_dropped (bigint; replacing columns of these names) are added, unless counts=False.

    Null text stays null (0 lines); a text whose lines all go becomes empty; a text without boilerplate
    stays as it is, byte for byte. Equal rows change alike. An empty table gives an empty table. The sites'
    line sets are a stored table: Spark sees its size and sends it to every task if it is small, and else
    joins by host, where AQE splits a hot host.
    """
    h, lines, bad, kept = free_name(docs, "host", "lines", "bad", "kept")
    sets = materialize(boilerplate_lines(docs, host, text, ratio, min_pages), "boilerplate")
    joined = docs.join(sets.select(F.col("host").alias(h), F.col("lines").alias(bad)), F.col(host).eqNullSafe(F.col(h)), "left").drop(h)
    cut = joined.withColumn(lines, F.split(F.col(text).cast("string"), "\n", -1))
    listed = lambda x: F.array_contains(F.get(bad, slot(x, F.size(bad))), x)
    cut = cut.withColumn(kept, F.when(F.col(bad).isNotNull(), F.filter(lines, lambda x: ~listed(F.xxhash64(x)))).otherwise(F.col(lines)))
    size = lambda c: F.when(F.col(lines).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    out = cut.withColumns({"n_lines": size(lines), "n_dropped": size(lines) - size(kept)}) if counts else cut
    return out.withColumn(text, F.when(size(kept) < size(lines), F.array_join(kept, "\n")).otherwise(F.col(text))).drop(lines, bad, kept)


#: drop_boilerplate over documents in DuckDB's SQL.
SQL = f"""
with p as (select source, count(*) pages from documents group by source),
l as (select source, unnest(list_distinct(string_split(text, chr(10)))) l from documents),
b as (select l.source, l from l join p on l.source is not distinct from p.source where trim(l) <> '' group by l.source, l, pages having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * pages),
u as (select doc_id, unnest(ls) l, generate_subscripts(ls, 1) i from (select doc_id, string_split(text, chr(10)) ls from documents)),
k as (select u.doc_id, u.i, u.l, b.l is not null bad from u join documents d using (doc_id) left join b on b.source is not distinct from d.source and b.l = u.l),
g as (select doc_id, count(*) n_lines, count(*) filter (bad) n_dropped, coalesce(string_agg(l, chr(10) order by i) filter (not bad), '') kept from k group by doc_id)
select doc_id, source, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_dropped, 0)::bigint n_dropped, case when n_dropped > 0 then kept else text end text from documents left join g using (doc_id)
"""
