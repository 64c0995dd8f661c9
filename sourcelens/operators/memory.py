"""Session memory: what earlier searches of a session found moves the scores of later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEGACY, KEPT_RECORDS, KEPT_PATHS, MAX_AGE, CLAMP = "__legacy__", 128, 8, 24, 4.0


def remembered(records: DataFrame, keep: int = KEPT_RECORDS) -> DataFrame:
    """The last `keep` records by seq: a bounded sort in each task."""
    return records.orderBy(F.desc("seq")).limit(keep)


def remember(records: DataFrame, query: DataFrame) -> DataFrame:
    """records and one more from query (seq, session_id, agent_id, terms, hits): its first eight hit
    paths. A search without hits isn't remembered."""
    new = query.where(F.size("hits") > 0).select("seq", F.coalesce("session_id", F.lit(LEGACY)).alias("session_id"), "agent_id", "terms", F.slice("hits", 1, KEPT_PATHS).alias("paths"))
    return remembered(records.unionByName(new))


def adjustments(records: DataFrame, terms: list[str], session_id: str | None, agent_id: str | None) -> DataFrame:
    """path, adjustment for every path that the session's records hold; other paths have none.

    Records count from the newest, by age 0 to 23, within the session. One that lists the path and shares
    terms adds 0.55 a shared term, or takes off 0.9 if it is another agent's, over 1 + 0.2 * age; clamped
    to 4 either way. Without a session, another agent's record that would count is left out and doesn't age
    the ones before it, so age depends on the path: it is the number of newer records that do age.
    """
    own = remembered(records.where(F.coalesce("session_id", F.lit(LEGACY)) == (session_id or LEGACY)))
    overlap = F.size(F.array_intersect(F.array_distinct("terms"), F.array(*(F.lit(t) for t in terms)).cast("array<string>")))
    # At most 128 records remain.
    held = own.select("seq", "agent_id", "paths", overlap.alias("overlap"))
    paths = held.select(F.explode(F.array_distinct("paths")).alias("path")).distinct()
    pairs = paths.join(F.broadcast(held)).withColumn("listed", F.array_contains("paths", F.col("path")))
    other = ~F.col("agent_id").eqNullSafe(F.lit(agent_id))
    skipped = F.lit(session_id is None and agent_id is not None) & F.col("listed") & (F.col("overlap") > 0) & other
    newer = Window.partitionBy("path").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    aged = pairs.withColumn("skipped", skipped).withColumn("age", F.coalesce(F.sum(F.when(F.col("skipped"), 0).otherwise(1)).over(newer), F.lit(0)))
    factor = F.when(F.lit(session_id is not None) & other, -0.9).otherwise(0.55)
    gain = F.when(F.col("listed") & ~F.col("skipped") & (F.col("age") < MAX_AGE), factor * F.col("overlap") / (1 + F.col("age") * 0.2)).otherwise(0.0)
    return aged.groupBy("path").agg(F.greatest(F.least(F.sum(gain), F.lit(CLAMP)), F.lit(-CLAMP)).alias("adjustment"))
