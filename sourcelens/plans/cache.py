"""Facts of file generations, kept between queries as stored tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Parts after which a cache is rewritten as one.
PARTS = 8


class StampCache:
    """Rows (path, stamp, and `schema`) by path and stamp. A generation without rows is known all the same. Of a
    path, the newest generation put is kept, and of all paths the `capacity` put last.

    Each put is a table of its own; when there are PARTS of them they are rewritten as one. The lock guards the
    list of parts; jobs run outside it."""

    def __init__(self, spark: SparkSession, label: str, schema: str, capacity: int = 4096):
        self.spark, self.label, self.capacity = spark, label, capacity
        self.columns = ["path", "stamp", *(c.split()[0] for c in schema.split(", "))]
        self.rows_schema = f"path string, stamp string, {schema}"
        self.parts: list[tuple[int, DataFrame, DataFrame]] = []
        self.seq, self._lock = 0, threading.Lock()

    def _both(self) -> tuple[DataFrame, DataFrame]:
        """Generations (path, stamp, seq) and rows (with seq) of all parts."""
        keys = self.spark.createDataFrame([], "path string, stamp string, seq int")
        rows = self.spark.createDataFrame([], f"{self.rows_schema}, seq int")
        for _, k, r in self.parts:
            keys, rows = keys.unionByName(k), rows.unionByName(r)
        return keys, rows

    def probe(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of wanted (path, stamp): the rows of the known generations, and the generations that aren't known."""
        keys, rows = self._both()
        newest = keys.groupBy("path").agg(F.max_by("stamp", "seq").alias("stamp"), F.max("seq").alias("seq"))
        known = wanted.select("path", "stamp").distinct().join(newest, ["path", "stamp"])
        return rows.join(known, ["path", "stamp", "seq"]).select(self.columns), wanted.join(known, ["path", "stamp"], "left_anti")

    def put(self, generations: DataFrame, rows: DataFrame) -> DataFrame:
        """Adds generations (path, stamp) and their rows, which it returns as they are stored."""
        with self._lock:
            self.seq += 1
            seq = self.seq
        mark = F.lit(seq).alias("seq")
        part = seq, stored(generations.select("path", "stamp", mark), f"{self.label}-keys"), stored(rows.select(*self.columns, mark), f"{self.label}-rows")
        with self._lock:
            self.parts = [*self.parts, part]
            full = len(self.parts) >= PARTS
        if full:
            self.rewrite()
        return part[2].select(self.columns)

    def rewrite(self) -> None:
        """Keeps the newest generation of the paths put last, as one part. The old parts' files go when this
        cache is rewritten again, so that a query that has begun can still read them."""
        with self._lock:
            old = self.parts
            keys, rows = self._both()
        newest = keys.groupBy("path").agg(F.max_by("stamp", "seq").alias("stamp"), F.max("seq").alias("seq"))
        kept = stored(newest.orderBy(F.desc("seq"), "path").limit(self.capacity).select("path", "stamp", "seq"), f"{self.label}-keys")
        part = max(p[0] for p in old), kept, stored(rows.join(kept, ["path", "stamp", "seq"]).select(*self.columns, "seq"), f"{self.label}-rows")
        with self._lock:
            self.parts = [part, *(p for p in self.parts if p not in old)]
            gone, self._gone = getattr(self, "_gone", []), old
        for _, k, r in gone:
            discard(k)
            discard(r)
