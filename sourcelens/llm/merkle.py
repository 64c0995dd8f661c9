"""Merkle-tree fingerprints of documents, in DataFrame functions only.

A text's sections are its lines, and a section's paragraphs are runs of up to eight words. A paragraph's
hash is of its text, a section's of its paragraphs' hashes, the root of the sections' hashes. Equal roots
mean equal texts; where roots differ, the branches that differ tell where.

The fingerprint is a string: the root (SHA-256, hex), ":", then for each section the first eight digits of
its hash, "=" and those of its paragraphs' hashes joined by ",", sections joined by ";".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PARAGRAPH = "(?:[^ ]+ *){1,8}| +"


def with_fingerprint(df: DataFrame, text: str, out: str, carry: list[str]) -> DataFrame:
    """carry and the fingerprint of df's string column `text` (null: empty) as `out`."""
    section = lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p))
    d = df.withColumn("__tree", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), section))
    short = lambda x: F.substring(x, 1, 8)
    branch = lambda s: F.concat(short(F.md5(F.concat_ws("", s))), F.lit("="), F.concat_ws(",", F.transform(s, short)))
    root = F.sha2(F.concat_ws(",", F.transform("__tree", lambda s: F.md5(F.concat_ws("", s)))), 256)
    return d.select(*carry, F.concat(root, F.lit(":"), F.concat_ws(";", F.transform("__tree", branch))).alias(out))


def nodes(fingerprint: Column) -> Column:
    """The tree's hashes below the root, each once."""
    return F.array_remove(F.array_distinct(F.split(F.substr(fingerprint, F.lit(66)), "[;=,]")), "")


def likeness(a: str, b: str) -> Column:
    """1 if the roots are equal, else twice the shared nodes over all nodes. a, b: columns of nodes()."""
    both, parts = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(parts == 0, F.lit(0.0)).otherwise(2.0 * both / parts)


def differing_sections(a: Column, b: Column) -> Column:
    """Places (from 0) of the first fingerprint's sections whose hash the second one doesn't have. The second one's
    hashes are taken once, as keys of a map."""
    heads = lambda f: F.transform(F.split(F.substr(f, F.lit(66)), ";"), lambda s: F.substring(s, 1, 8))
    known = F.map_from_arrays(F.array_distinct(heads(b)), F.transform(F.array_distinct(heads(b)), lambda _: F.lit(True)))
    missing = lambda held: F.filter(F.transform(heads(a), lambda s, k: F.when(~F.map_contains_key(held, s), k)), lambda k: k.isNotNull())
    return F.transform(F.array(known), missing)[0]


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, next_id over the distinct non-null ids of docs in descending order, the last one's next
    being the first, and n_chars (the longest of the id's texts).

    Ids are dealt into ranges; a window runs within each range, and one over the ranges' first ids joins
    their ends, so no task sees all ids. The ranges are stored, as both windows must see the same.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    dealt = materialize(ids.repartitionByRange(F.desc("doc_id")).withColumn("range", F.spark_partition_id()), "merkle-order")
    first = dealt.groupBy("range").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("range")
    ends = first.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("next", F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.desc("doc_id"))))
    # A row for each partition of the order.
    return inside.join(F.broadcast(ends), "range").select("doc_id", "n_chars", F.coalesce("next", "after").alias("next_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints each text, and its text with the last half replaced by the next document's start.

    Returns a row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as empty.
    Where an id has several rows, all take the same next document, and as the next document the id stands
    with the least of its texts (cut to what is needed). A null id has no next document: it takes an empty
    one. Shuffled: each text once, by id, and of the next document only the characters needed and the
    fingerprint.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = d.where(F.col("doc_id").isNotNull())
    order = materialize(successors(d), "merkle-next")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    heads = with_fingerprint(known.join(wanted, "doc_id").select("before", F.substr("text", F.lit(1), "half").alias("head"), "text"), "text", "next_fingerprint", ["before", "head"])
    heads = heads.groupBy("before").agg(F.min(F.struct("head", "next_fingerprint")).alias("next")).select(F.col("before").alias("doc_id"), "next.*")
    half = F.floor(F.length("text") / 2).cast("int")
    # Both joins see the same rows with an id, so that their texts are dealt out once for both.
    own = known.join(heads, "doc_id", "left").unionByName(d.where(F.col("doc_id").isNull()).withColumns({"head": F.lit(None).cast("string"), "next_fingerprint": F.lit(None).cast("string")})).withColumn("half", half)
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("half")), F.coalesce(F.substr("head", F.lit(1), "half"), F.lit("")))
    own = own.withColumn("edited", edited).select("doc_id", "text", "edited", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_fingerprint")
    own = with_fingerprint(own, "text", "fingerprint", ["doc_id", "edited", "n_chars", "edited_sha256", "next_fingerprint"])
    own = with_fingerprint(own, "edited", "edited_fingerprint", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "next_fingerprint"])
    trees = own.select("*", nodes(F.col("fingerprint")).alias("a"), nodes(F.col("edited_fingerprint")).alias("b"), nodes(F.coalesce("next_fingerprint", F.lit(""))).alias("c"))
    root = lambda c: F.substring(c, 1, 64)
    near = lambda other, part: F.when(root("fingerprint") == root(other), F.lit(1.0)).otherwise(likeness("a", part))
    return trees.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "b").alias("near_edited"), near("next_fingerprint", "c").alias("near_next"))


_TREE = "list_transform(string_split({t}, chr(10)), lambda s: list_transform(regexp_extract_all(s, '" + PARAGRAPH.replace("{", "{{").replace("}", "}}") + "'), lambda p: md5(p)))"
_PRINT = "sha256(array_to_string(list_transform({t}, lambda s: md5(array_to_string(s, ''))), ',')) || ':' || array_to_string(list_transform({t}, lambda s: md5(array_to_string(s, ''))[:8] || '=' || array_to_string(list_transform(s, lambda x: x[:8]), ',')), ';')"
_NODES = "list_filter(list_distinct(string_split(replace(replace({f}[66:], ';', ','), '=', ','), ',')), lambda x: x <> '')"
_NEAR = "case when fp[:64] = {f}[:64] then 1.0 when len(a) + len({x}) = 0 then 0.0 else 2.0 * len(list_intersect(a, {x})) / (len(a) + len({x})) end"
#: The same in DuckDB's SQL, for unique ids.
SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
o as (select *, length(t) n, coalesce(lead(t) over o, first(t) over (order by doc_id desc)) x from d window o as (order by doc_id desc)),
e as (select doc_id, n, t, x, t[:n - n // 2] || x[:n // 2] e from o),
tr as (select doc_id, n, sha256(e) edited_sha256, {_TREE.format(t="t")} tt, {_TREE.format(t="e")} te, {_TREE.format(t="x")} tx from e),
f as (select doc_id, n, edited_sha256, {_PRINT.format(t="tt")} fp, {_PRINT.format(t="te")} ef, {_PRINT.format(t="tx")} nf from tr),
z as (select *, {_NODES.format(f="fp")} a, {_NODES.format(f="ef")} b, {_NODES.format(f="nf")} c from f)
select doc_id, n::bigint n_chars, edited_sha256, fp fingerprint, ef edited_fingerprint, ({_NEAR.format(f="ef", x="b")})::double near_edited, ({_NEAR.format(f="nf", x="c")})::double near_next from z
"""
