"""How much is scanned, in which order, and what is known of the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order, policy, rank
from ..functions import text as T
from ..storage import stored

MIB = 1 << 20
FIRST_ROUND, LAST_ROUND, STOP_CONFIDENCE = 32 * MIB, 512 * MIB, 0.78
SAMPLE_OF = 8


def sample_hash(path: Column) -> Column:
    """A stable number of a path: the first 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(path), 1, 7), 16, 10).cast("bigint")


def lanes(files: DataFrame, size: str | None = None, most: int | None = None) -> DataFrame:
    """files (path, path_bonus, changed) with lane and place: changed files and ones whose path holds a
    term come first, then an eighth by hash, then the rest in turn over the top directories. A lane of any size is split
    over tasks. With size, a column of files, also upto: its sum in the lane up to the file. most: files there are at most."""
    h = sample_hash(F.col("path"))
    lane = F.when(F.col("changed") | (F.col("path_bonus") > 0), "priority").when(h % SAMPLE_OF == 0, "sample").otherwise("broad")
    d = files.withColumns({"lane": lane, "h": h, "top": F.split("path", "/")[0]})
    d = order.running(d, ["lane", "top"], ["path"], "turn", most=most)
    key = lambda name, c: F.when(F.col("lane") == name, c)
    by = [key("priority", (~F.col("changed")).cast("int")), key("priority", -F.col("path_bonus")), key("sample", F.col("h")), key("broad", F.col("turn")), key("broad", F.col("top")), F.col("path")]
    return order.running(d, ["lane"], by, "place", upto=("upto", F.col(size)) if size else None, most=most).drop("h", "top", "turn")


#: Groups of more items than this are not folded.
FOLDED = 512


def fit_budget(items: DataFrame, group: str, order_by: list[str], size: str, budget: int) -> DataFrame:
    """items with taken: in order, each group takes what still fits its budget and passes over what doesn't.

    A small group is folded in one row. A large one goes by rounds over running totals: it takes the longest
    prefix that fits, and of the rest only what isn't larger than what is left goes on. So no array holds it and no task has to."""
    large = items.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > FOLDED).select(F.col(group).alias("_g"))
    if large.isEmpty():
        return _folded(items, group, order_by, size, budget)
    large = stored(large, "budget-groups")
    is_large = F.col(group).eqNullSafe(F.col("_g"))
    small = _folded(items.join(large, is_large, "left_anti"), group, order_by, size, budget)
    return small.unionByName(_by_rounds(items.join(large, is_large, "left_semi"), group, order_by, size, budget))


def _folded(items: DataFrame, group: str, order_by: list[str], size: str, budget: int) -> DataFrame:
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(size).alias("_s"), F.struct(*items.columns).alias("_r")))).alias("rs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["_s"] <= budget
        return F.struct((acc["used"] + F.when(fits, r["_s"]).otherwise(0)).cast("bigint").alias("used"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    done = rows.select(F.explode(F.arrays_zip(F.transform("rs", lambda r: r["_r"]).alias("r"), F.aggregate("rs", start, step)["taken"].alias("taken"))).alias("x"))
    return done.select("x.r.*", "x.taken")


def _by_rounds(items: DataFrame, group: str, order_by: list[str], size: str, budget: int) -> DataFrame:
    """Each round is one pass of running totals and a stored table. A round takes the first item that is left, so
    rounds end; what is left shrinks with what the budget has left, so they are few."""
    columns, out = items.columns, []
    left = items.withColumn("_rest", F.lit(budget).cast("bigint"))
    while True:
        dealt = order.running(left, [group], order_by, "_upto", F.col(size))
        marked = stored(dealt.withColumn("taken", F.col("_upto") <= F.col("_rest")), "budget-round")
        used = marked.groupBy(F.col(group).alias("_g")).agg(F.coalesce(F.sum(F.when(F.col("taken"), F.col(size))), F.lit(0)).alias("_used"))
        after = marked.join(used, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_rest", F.col("_rest") - F.col("_used"))
        goes_on = ~F.col("taken") & (F.col(size) <= F.col("_rest"))
        out.append(after.where(~goes_on).select(*columns, "taken"))
        left = after.where(goes_on).select(*columns, "_rest")
        if left.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), out)


#: Items that the driver looks at together (their places and sizes), and how often it does so for a lane.
HEAD, HEADS = 4096, 4


def fit_lane(lane: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """What fit_budget takes of one of `lanes`, a stored table (place, length, upto and others), and its bytes.

    The running totals are there already, so the longest prefix that fits is a filter. What is left of the budget
    is less than the file after it, so few files more fit: the next HEAD of small enough ones are looked at in order, and
    what is left then is smaller. If that isn't the end after HEADS times, rounds of running totals go on."""
    size, place = F.col("length"), F.col("place")
    fits = F.col("upto") <= budget
    used = lane.agg(F.coalesce(F.sum(F.when(fits, size)), F.lit(0))).first()[0]
    more, after = [], 0
    for _ in range(HEADS):
        rest = lane.where(~fits & (place > after) & (size <= budget - used))
        head = rest.select("place", "length").orderBy("place").limit(HEAD).collect()
        for r in head:
            if used + r["length"] <= budget:
                used += r["length"]
                more.append(r["place"])
        if len(head) < HEAD:
            return lane.where(fits | place.isin(more)), used
        after = head[-1]["place"]
    rest = lane.where(~fits & (place > after) & (size <= budget - used))
    late = stored(_by_rounds(rest, "lane", ["place"], "length", budget - used).where("taken").drop("taken"), "chosen")
    used += late.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return lane.where(fits | place.isin(more)).unionByName(late), used


def split_budget(budget: int) -> tuple[int, int, int, int]:
    """Of a round's bytes: those for the index and for verifying candidates (a quarter), and of the index's
    those that the priority lane (half) and the sample lane (an eighth) may take at most."""
    indexed = budget * 3 // 4
    return indexed, budget - indexed, indexed // 2, indexed // 8


def coverage(audit: DataFrame) -> DataFrame:
    """One row of counters over an audit table (path, reason, indexed): files, excluded, indexed, eligible,
    complete, percent (of eligible files; 100 without any). A file that couldn't be read is eligible all
    the same, so the scan is then incomplete."""
    failed = policy.makes_incomplete(F.col("reason"))
    excluded = F.col("reason").isNotNull() & ~failed
    c = audit.agg(F.count("*").alias("files"), F.count_if(excluded).alias("excluded"), F.count_if(F.col("reason").isNull() & F.col("indexed")).alias("indexed"), F.count_if(~excluded).alias("eligible"))
    return c.select("*", (F.col("indexed") == F.col("eligible")).alias("complete"), F.expr("case when eligible = 0 then 100 else 100 * indexed div eligible end").alias("percent"))


def confidence(hits: DataFrame, terms: list[str], indexed: Column, eligible: Column, truncated: Column, excluded: Column) -> DataFrame:
    """One row, confidence in [0, 1]: hits are (path, excerpt, score); the other arguments are literals."""
    best = rank.top(hits, 3).agg(*(F.max((F.contains(T.ascii_lower(F.col("path")), F.lit(t)) | F.contains(T.ascii_lower(F.col("excerpt")), F.lit(t))).cast("int")).alias(f"c{i}") for i, t in enumerate(terms)), F.max("score").alias("s1"), F.sort_array(F.collect_list("score"), asc=False).alias("ss"))
    n = hits.agg(F.count("*").alias("n"))
    covered = rank.add([F.coalesce(F.col(f"c{i}"), F.lit(0)) for i in range(len(terms))]) / len(terms)
    s2 = F.coalesce(F.try_element_at("ss", F.lit(2)), F.lit(0.0))
    margin = F.when(F.col("s1") > 0, (F.col("s1") - s2) / F.col("s1")).otherwise(0.0)
    known = F.when(eligible > 0, indexed / eligible).otherwise(1.0)
    raw = 0.48 * covered + 0.20 * margin + 0.12 * F.least(F.col("n"), F.lit(6)) / 6 + 0.20 * known + F.when(~truncated & (excluded == 0), 0.08).otherwise(0.0)
    none = F.when(truncated, 0.05).when(excluded > 0, 0.35).otherwise(0.98)
    return n.crossJoin(F.broadcast(best)).select(F.when(F.col("n") == 0, none).otherwise(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).alias("confidence"))


def confidence_of(hits: list[dict], terms: list[str], indexed: int, eligible: int, truncated: bool, excluded: int) -> float:
    """`confidence` of a query's own hits, on the driver."""
    if not hits:
        return 0.05 if truncated else 0.35 if excluded else 0.98
    low = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
    best = sorted(hits, key=lambda h: (-h["score"], h["path"]))[:3]
    seen = [low(h["path"]) + "\0" + low(h["excerpt"]) for h in best]
    covered = sum(any(t in x for x in seen) for t in terms) / len(terms)
    first, second = best[0]["score"], best[1]["score"] if len(best) > 1 else 0.0
    margin = (first - second) / first if first > 0 else 0.0
    known = indexed / eligible if eligible else 1.0
    raw = 0.48 * covered + 0.20 * margin + 0.12 * min(len(hits), 6) / 6 + 0.20 * known + (0.08 if not truncated and not excluded else 0.0)
    return min(max(raw, 0.0), 1.0)


@dataclass
class Round:
    budget: int
    confidence: float
    truncated: bool
    expandable: bool = True


def adapt(run: Callable[[int], Round], cap: int = LAST_ROUND, first: int = FIRST_ROUND) -> Round:
    """Runs rounds of doubling budgets until one is complete, sure enough, or at the cap."""
    budget = min(first, cap)
    while True:
        got = run(budget)
        if not (got.truncated and got.expandable) or got.confidence >= STOP_CONFIDENCE or budget >= cap:
            return got
        budget = min(2 * budget, cap)
