"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.corpus import table  # noqa: F401

#: The characters that end a word: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir."""
    return f"{storage.shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Cuts the lineage: a Parquet table in the shared folder. A lost executor costs at most the tasks that read it again.
materialize, discard = storage.stored, storage.discard


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def star_components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: two bigint columns a and b, a row for each link (repeats and loops allowed).
    Returns node, root: each node that has a link to another, with the smallest node of its component.
    Each round is two aggregations and two joins on node; a written table between the rounds cuts the
    lineage (it is deleted once the next one is there), and only a count and a checksum reach the driver. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the neighbours below u, and u, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
