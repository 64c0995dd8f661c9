"""The term index as a versioned table in a shared folder, kept up to date by differences.

An update writes the postings, grams and metadata of changed files only, as a segment of their own, then the
new table of documents, and at last a manifest, which makes the version visible: a reader sees the one before
or all of the new one, and an update that fails leaves files that no manifest names. Postings and grams are
bucketed by term, so a query reads the buckets of its own terms; a row counts if the table of documents says that its segment
is the path's newest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index
from ..storage import discard, stored

DOCUMENTS = "path string, stamp string, dl bigint, entries bigint, truncated boolean, segment string"
POSTINGS = "term string, path string, tf bigint, segment string, bucket int"
GRAMS = "gram string, path string, segment string, bucket int"
SKIPS = "path string, stamp string, reason string"
#: Rows of postings and grams that a part of a bucket holds, about.
TOGETHER = 500_000
#: Segments after which an update merges all of them.
MERGED_AT = 16


@dataclass
class Manifest:
    """What a version consists of. saturated: files were left out as the entries would pass the cap."""

    version: int = 0
    segments: list[str] = field(default_factory=list)
    documents: int = 0
    length: int = 0
    entries: int = 0
    saturated: bool = False
    buckets: int = 16
    tables: str = ""


class StoredIndex:
    """An index under `root`, a folder that driver and executors share. One writer at a time: of two that make
    the same version, the second one fails."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, cap: int = index.MAX_ENTRIES, max_terms: int | None = None, max_grams: int | None = None):
        self.spark, self.root, self.cap, self.max_terms, self.max_grams = spark, root.rstrip("/"), cap, max_terms, max_grams
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._newest() or Manifest(buckets=buckets)

    # --- Files. ---
    def _versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _newest(self) -> Manifest | None:
        versions = self._versions()
        if not versions:
            return None
        stream = self._fs.open(self._jvm_path(f"{self.root}/manifest/{versions[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def refresh(self) -> None:
        """Takes what another process has written."""
        self.manifest = self._newest() or self.manifest

    def _publish(self, new: Manifest) -> None:
        name, draft = (self._jvm_path(f"{self.root}/manifest/{x}") for x in (f"{new.version}.json", f"_{uuid.uuid4().hex}"))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {new.version} of the index was written by another process")
        self.manifest = new

    def vacuum(self) -> int:
        """Deletes what the newest version doesn't need, and returns how many folders that were. No query may
        still be reading an older one."""
        gone = 0
        for kind, keep in (("postings", {f"segment={s}" for s in self.manifest.segments}), ("grams", {f"segment={s}" for s in self.manifest.segments}), ("documents", {self.manifest.tables}), ("skips", {self.manifest.tables})):
            folder = self._jvm_path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if s.isDirectory() and s.getPath().getName() not in keep:
                    gone += bool(self._fs.delete(s.getPath(), True))
        for v in self._versions()[:-1]:
            self._fs.delete(self._jvm_path(f"{self.root}/manifest/{v}.json"), False)
        return gone

    # --- Reading. ---
    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._jvm_path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def documents(self) -> DataFrame:
        """DOCUMENTS: a row for each indexed file."""
        return self._read(f"{self.root}/documents/{self.manifest.tables or None}", DOCUMENTS)

    def skips(self) -> DataFrame:
        """SKIPS: generations of files that reading has shown to be excluded by policy."""
        return self._read(f"{self.root}/skips/{self.manifest.tables or None}", SKIPS)

    def bucket(self, column: str) -> Column:
        return F.pmod(F.hash(column), F.lit(self.manifest.buckets)).cast("int")

    def postings(self) -> DataFrame:
        """path, term, tf of all indexed files."""
        rows = self._read(f"{self.root}/postings", POSTINGS).where(F.col("segment").isin(self.manifest.segments))
        return rows.join(self.documents().select("path", "segment"), ["path", "segment"]).select("path", "term", "tf")

    def _wanted(self, kind: str, schema: str, column: str, values: list[str]) -> DataFrame:
        """Rows of the newest segments whose column is one of values: only their buckets are read."""
        rows = self._read(f"{self.root}/{kind}", schema).where(F.col("segment").isin(self.manifest.segments) & F.col(column).isin(values))
        # hash() of a literal is folded, so the buckets are constants of the partition filter.
        return rows.where(F.col("bucket").isin([F.pmod(F.hash(F.lit(v)), F.lit(self.manifest.buckets)).cast("int") for v in values]))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """path, dl, tf0..: of indexed files that may hold a term, how often each is a whole token or a fragment
        of one, or 1 where only the grams say so."""
        every = {t: sorted(set(T.query_grams(t))) for t in terms}
        at = {g: i for i, g in enumerate(sorted({g for of in every.values() for g in of}))}
        post = self._wanted("postings", POSTINGS, "term", terms).select("path", "segment", "term", "tf", F.lit(None).cast("string").alias("gram"))
        held = self._wanted("grams", GRAMS, "gram", list(at)).select("path", "segment", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"), "gram")
        # Both are looked at in one aggregation, so a file's rows meet once, and its newest segment once.
        own = {f"own{i}": F.max(F.when(F.col("term") == t, F.col("tf"))) for i, t in enumerate(terms)} | {f"gram{i}": F.max(F.col("gram") == g) for g, i in at.items()}
        found = post.unionByName(held).groupBy("path", "segment").agg(*(c.alias(name) for name, c in own.items()))
        loose = [reduce(and_, (F.coalesce(f"gram{at[g]}", F.lit(False)) for g in every[t])) if every[t] else F.lit(False) for t in terms]
        wide = found.select("path", "segment", *(F.greatest(F.coalesce(f"own{i}", F.lit(0)), loose[i].cast("bigint")).alias(f"tf{i}") for i in range(len(terms))))
        return wide.where(reduce(or_, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).join(self.documents().select("path", "segment", "dl"), ["path", "segment"]).drop("segment")

    # --- Writing. ---
    def states(self, listed: DataFrame, complete: bool = True) -> DataFrame:
        """path, state of listed files (path, stamp) and indexed ones, as `index.reconcile` gives them."""
        return index.reconcile(listed, self.documents(), ["stamp"], F.lit(complete))

    def update(self, states: DataFrame, fresh: DataFrame, again: bool = True) -> Manifest:
        """Brings the index up to date: files that states (path, state) calls deleted or changed go, and fresh
        (path, text, reason, stamp, place), what was read of missing and changed ones, joins in order of place
        until the cap of entries. Rows with a reason that policy gives are remembered as skips; other failures
        leave the file out. again: fresh is stored first, as it is read more than once; not needed for a filter over
        a stored table. Returns the version that is then the newest."""
        fresh = fresh.select("path", "text", "reason", "stamp", F.col("place").cast("bigint").alias("place"))
        fresh = stored(fresh, "index-fresh") if again else fresh
        good = fresh.where("reason is null and text is not null").select("path", "stamp", "place", "text")
        made = index.limited(index.entries(good, grams=self.max_grams is None), self.max_terms)
        made = made.withColumn("grams_cut", F.lit(False)) if self.max_grams is None else made.join(index.first_grams(good, self.max_grams), "path")
        # A row for each document, with its terms and grams: they are counted and chosen before they are dealt out.
        made = stored(made.select("path", "stamp", "dl", "place", (F.size("terms") + F.size("grams")).cast("bigint").alias("entries"), (F.col("terms_cut") | F.col("grams_cut")).alias("truncated"), "terms", "terms_cut", "grams"), "index-made")

        held = self.documents()
        stale = states.where("state in ('deleted', 'changed')").select("path").unionByName(made.select("path"))
        kept = stored(held.join(stale, "path", "left_anti"), "index-kept")
        have = kept.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
        n_made, wanted = made.agg(F.count("*"), F.coalesce(F.sum("entries"), F.lit(0))).first()
        segment, name, new = uuid.uuid4().hex, uuid.uuid4().hex, made
        if wanted > self.cap - have:
            joined = index.saturated(made.select(F.col("place").alias("seq"), "path", F.col("entries").alias("n")), self.cap - have).where("kept").select("path")
            new = made.join(joined, "path", "left_semi")
        new = new.withColumn("segment", F.lit(segment))
        self._write_segment(segment, index.posted(new), new.select("path", F.explode("grams").alias("gram")), min(wanted, self.cap - have))
        documents = f"{self.root}/documents/{name}"
        columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
        kept.select(columns).unionByName(new.select(columns)).write.parquet(documents)
        # A skip lasts as long as its generation; a file that is gone is listed no more.
        skipped = fresh.where(F.col("reason").isin("non_utf8", "hard_linked") & F.col("stamp").isNotNull()).select("path", "stamp", "reason")
        old = self.skips().join(fresh.select("path"), "path", "left_anti").join(states.where("state = 'deleted'").select("path"), "path", "left_anti")
        old.unionByName(skipped).write.parquet(f"{self.root}/skips/{name}")
        now = self._read(documents, DOCUMENTS)
        n, length, total, n_new = now.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0)), F.count_if(F.col("segment") == segment)).first()
        segments = [*self.manifest.segments, segment]
        manifest = Manifest(self.manifest.version + 1, segments, n, length, total, n_new < n_made, self.manifest.buckets, name)
        for table in (*[fresh] * again, made, kept):
            discard(table)
        if len(segments) > MERGED_AT:
            manifest = self._merged(manifest, now)
        self._publish(manifest)
        return manifest

    def _write_segment(self, segment: str, post: DataFrame, sketch: DataFrame, entries: int) -> None:
        """A file for each bucket and part of the paths, ordered by term; parts hold about TOGETHER rows, so a term
        of most files is several tasks and files. The place of a row is known without looking at the others."""
        parts = max(1, -(-entries // (self.manifest.buckets * TOGETHER)))
        for kind, rows, column in (("postings", post.select("term", "path", "tf"), "term"), ("grams", sketch.select("gram", "path"), "gram")):
            task = F.col("bucket") * parts + F.pmod(F.hash("path"), F.lit(parts))
            dealt = rows.withColumn("bucket", self.bucket(column)).repartitionById(self.manifest.buckets * parts, task.cast("int")).sortWithinPartitions("bucket", column)
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{kind}/segment={segment}")

    def _merged(self, manifest: Manifest, now: DataFrame) -> Manifest:
        """One segment of what counts of all."""
        segment, live = uuid.uuid4().hex, now.select("path", "segment")
        of = lambda kind, schema: self._read(f"{self.root}/{kind}", schema).where(F.col("segment").isin(manifest.segments)).join(live, ["path", "segment"])
        self._write_segment(segment, of("postings", POSTINGS), of("grams", GRAMS), manifest.entries)
        whole = stored(now.withColumn("segment", F.lit(segment)), "index-documents")
        whole.write.mode("overwrite").parquet(f"{self.root}/documents/{manifest.tables}")
        discard(whole)
        return replace(manifest, segments=[segment])
