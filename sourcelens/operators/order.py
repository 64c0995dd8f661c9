"""Places and running totals over an order, with no key or whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a range, about, where their number is known.
RANGE = 10_000


def running(df: DataFrame, keys: list[str], order: list[str | Column], name: str, of: Column | None = None, upto: tuple[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """df with `name` (bigint): the place from 1 of each row among those of equal keys, or with `of` the sum of
    that up to the row. Rows equal in keys and order take places in any order. upto: a further name, and what is
    summed under it in the same pass. most: rows that df has at most, if known; a few rows aren't many ranges.

    Rows are dealt into ranges of keys and order, so a hot key is split; the ranges are stored, as sampled
    bounds may differ between runs. A row's value is its value within its range plus the totals of the key's
    earlier ranges, of which there are as many as partitions."""
    sums = {name: "_of"} | ({} if upto is None else {upto[0]: "_upto_of"})
    rows = df.withColumns({c: x.cast("bigint") for c, x in zip(sums.values(), (F.lit(1) if of is None else of, *(upto or ())[1:]))})
    # A number as parameter keeps every partition: AQE would join small ones, and none is split by it.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most is not None:
        n = min(n, max(1, -(-most // RANGE)))
    dealt = stored(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    key = [f"_k{i}" for i in range(len(keys))]
    totals = dealt.groupBy(*(F.col(k).alias(a) for k, a in zip(keys, key, strict=True)), F.col("_range").alias("_r")).agg(*(F.sum(c).alias(f"{c}_total") for c in sums.values()))
    earlier = Window.partitionBy(*key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "_r", *(F.coalesce(F.sum(f"{c}_total").over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums.values()))
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({f"{c}_within": F.sum(c).over(own) for c in sums.values()})
    same = F.col("_range") == F.col("_r")
    for k, a in zip(keys, key, strict=True):
        same &= F.col(k).eqNullSafe(F.col(a))
    out = within.join(before, same).withColumns({c: F.col(f"{o}_within") + F.col(f"{o}_before") for c, o in sums.items()})
    return out.drop(*key, "_r", "_range", *(f"{o}{x}" for o in sums.values() for x in ("", "_before", "_within")))


def before(df: DataFrame, keys: list[str], order: list[str | Column], name: str, value: str) -> DataFrame:
    """df with `name`: `value` of the row before it in order among those of equal keys, null for the first one.

    Ranges are dealt and stored as in `running`; the first row of a range takes the last value of the key's
    range before, found among one row for each key and range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys, "_range").orderBy(*order)
    within = dealt.withColumns({"_own": F.lag(value).over(own), "_first": F.row_number().over(own) == 1, "_last": F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order)))})
    key = [f"_k{i}" for i in range(len(keys))]
    ends = within.where("_last = 1").select(*(F.col(k).alias(a) for k, a in zip(keys, key, strict=True)), F.col("_range").alias("_r"), F.col(value).alias("_end"))
    ends = ends.select(*key, "_r", F.lag("_end").over(Window.partitionBy(*key).orderBy("_r")).alias("_carried"))
    same = F.col("_range") == F.col("_r")
    for k, a in zip(keys, key, strict=True):
        same &= F.col(k).eqNullSafe(F.col(a))
    return within.join(ends, same).withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own"))).drop(*key, "_r", "_carried", "_own", "_first", "_last", "_range")


def ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df dealt into ranges of keys and order, and put in order in each: every range is a task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df, "ranges").repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
