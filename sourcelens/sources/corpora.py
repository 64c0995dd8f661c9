"""Where a query's files come from: what there is, and the texts of chosen paths."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from . import files

#: What `files` and `texts` return. A stamp names one generation of a file.
LISTED = "path string, reason string, length bigint, stamp string"
READ = "path string, text string, reason string, stamp string"
STAMP_COLUMNS = ("length", "mtime_ns", "dev", "ino", "ctime_ns", "nlink")
#: Paths that one task reads.
READ_TOGETHER = 64


def stamp_of(columns: tuple[str, ...]) -> Column:
    return F.concat_ws(":", *(F.col(c).cast("string") for c in columns))


class Tree:
    """A directory tree that driver and executors see alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.realpath(root)
        self.identity = files.identity(self.root)

    def files(self) -> tuple[DataFrame, bool]:
        """LISTED, and whether a discovery cap cut it."""
        listed = files.load(self.spark, self.root, texts=False)
        rows = listed.select("path", "reason", F.coalesce("length", F.lit(0)).alias("length"), stamp_of(STAMP_COLUMNS).alias("stamp"))
        good, cut = files.capped(rows)
        return (good.unionByName(rows.where("reason is not null")) if cut else rows), cut

    def texts(self, paths: DataFrame) -> DataFrame:
        """READ of the paths, each opened by itself; nothing else of the tree is looked at."""
        root, identity = self.root, self.identity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if files.identity(root) != identity:
                raise RuntimeError("the root was replaced since it was opened")
            for b in batches:
                for path in b.column(0).to_pylist():
                    text, reason, stamp = files.read_source(root, path)
                    row = [path, text, reason, ":".join(map(str, stamp)) if stamp else None]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["path", "text", "reason", "stamp"])

        chosen = paths.select("path")
        return chosen.repartition(max(1, -(-chosen.count() // READ_TOGETHER)), "path").mapInArrow(run, READ)

    def stamps(self, paths: list[str]) -> dict[str, str]:
        """The stamps that these paths, a few, have now."""
        out = {}
        for path in paths:
            try:
                now = os.stat(f"{self.root}/{path}", follow_symlinks=False)
            except OSError:
                continue
            out[path] = ":".join(str(x) for x in (now.st_size, now.st_mtime_ns, now.st_dev, now.st_ino, now.st_ctime_ns, now.st_nlink))
        return out


class Table:
    """A corpus (path, text; optional: reason, stamp). Without stamps, one is made from the text."""

    def __init__(self, corpus: DataFrame, apply_policy: bool = True):
        rows = corpus if "reason" in corpus.columns else policy.with_reason(corpus) if apply_policy else corpus.withColumn("reason", F.lit(None).cast("string"))
        stamp = F.col("stamp").cast("string") if "stamp" in corpus.columns else F.md5("text")
        self.rows = rows.select("path", "text", "reason", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("length"), stamp.alias("stamp"))

    def files(self) -> tuple[DataFrame, bool]:
        missing = F.when(F.col("text").isNull(), "io")
        return self.rows.select("path", F.coalesce("reason", missing).alias("reason"), "length", "stamp"), False

    def texts(self, paths: DataFrame) -> DataFrame:
        return self.rows.join(paths.select("path").distinct(), "path", "left_semi").select("path", "text", "reason", "stamp")

    def stamps(self, paths: list[str]) -> dict[str, str]:
        """The stamps that these paths, a few, have now."""
        return {r["path"]: r["stamp"] for r in self.rows.where(F.col("path").isin(paths)).select("path", "stamp").collect()}
