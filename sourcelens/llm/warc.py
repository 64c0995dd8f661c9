"""WARC archives, written in shards that are the same for the same rows, and read back.

Records are range-sorted by page id. Ranges are cut at exact running byte counts over the sorted ids, so they
hold about the same whatever the ids are. Each task writes its range into files that roll once they reach a
size in compressed bytes, every record a gzip member of its own. Headers and digests are made anew from the
payload, so nothing depends on time or place. A file is written under a temporary name of its own; after all
tasks have ended, a second job renames the files that the successful attempts reported to their final names
and the manifest is written last. A reader trusts the manifest only, so what a lost executor or a second
attempt left behind doesn't count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: A file is closed once it holds so many compressed bytes; shorter payloads than DEDUP_BYTES aren't deduplicated.
ROLL_BYTES, DEDUP_BYTES = 8_000_000, 100
#: Payload bytes of one range, about; more if there would be over MAX_RANGES ranges, as their first keys are
#: part of the plan (at most some 700 kB).
RANGE_BYTES, MAX_RANGES = 32_000_000, 16_384
#: Tasks that read an archive, at most.
READERS = 8192
LOWEST = -(1 << 63)
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI that all machines share."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def one_line(value: object) -> str:
    return " ".join(str(value).split())


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One WARC/1.1 record. A response holds an HTTP message with the payload, a revisit only its head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    lines += [] if url is None else [f"WARC-Target-URI: {one_line(url)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    lines += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and the order of records: key (page_id, null ids first) and mark, a
    hash of the digest, so that equal payloads of one id stay together; rows without an id are told apart
    by url too."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    key = F.coalesce(F.expr("try_cast(page_id as bigint)"), F.lit(LOWEST))
    return p.withColumns({"key": key, "mark": F.when(F.col("page_id").isNull(), F.xxhash64("digest", "url")).otherwise(F.xxhash64("digest"))})


def references(slim: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """page_id, digest, key, mark, refers_to, once for each page with a payload of at least dedup_bytes bytes
    that occurs more than once: the smallest page_id with that payload (the page itself too refers to it).
    slim: prepared rows without the payload, but `bytes`. A hot payload costs one row a task, and its join
    meets rows of a few bytes, which AQE splits."""
    long = slim.where(F.col("bytes") >= dedup_bytes)
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    # The stored table's size decides between a broadcast and a shuffle by digest.
    return long.join(materialize(first, "warc-first"), "digest").select("page_id", "digest", "key", "mark", "refers_to").distinct()


def range_starts(slim: DataFrame, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """The first (key, mark) of each range but the first, in order: ranges hold about range_bytes payload
    bytes of consecutive (key, mark). They depend on the rows alone, not on how they are dealt.

    Rows without payloads are sorted in tasks and their running sums taken there; the sums of the tasks,
    one row each, are added up over all. Only the starts, at most MAX_RANGES, reach the driver.
    """
    dealt = materialize(slim.select("key", "mark", "bytes").repartitionByRange("key", "mark").withColumn("task", F.spark_partition_id()), "warc-order")
    each = dealt.groupBy("task").agg(F.sum("bytes").alias("n"))
    before = each.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("whole"))
    own = F.sum("bytes").over(Window.partitionBy("task").orderBy("key", "mark").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # A row for each task.
    summed = dealt.withColumn("own", own).join(F.broadcast(before), "task")
    size = F.greatest(F.lit(range_bytes), F.ceil(F.col("whole") / MAX_RANGES))
    at = summed.select("key", "mark", F.floor((F.col("before") + F.col("own") - 1) / size).alias("at"))
    starts = at.groupBy("at").agg(F.min(F.struct("key", "mark")).alias("s")).select("s.*")
    return sorted(map(tuple, starts.collect()))[1:]


def range_of(starts: list[tuple[int, int]]) -> Column:
    """The number of starts at or below the row's (key, mark), by bisection in a constant array."""
    if not starts:
        return F.lit(0)
    numbers = lambda i: F.split(F.lit(",".join(str(s[i]) for s in starts)), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))
    keys, marks = numbers(0), numbers(1)

    def narrower(span: Column, _: Column) -> Column:
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        k = F.get(keys, middle)
        below = (k < F.col("key")) | ((k == F.col("key")) & (F.get(marks, middle) <= F.col("mark")))
        open_ = span["low"] < span["high"]
        low = F.when(open_ & below, middle + 1).otherwise(span["low"])
        return F.struct(low.alias("low"), F.when(open_ & ~below, middle).otherwise(span["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), narrower)["low"]


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are ignored) to the folder `path`, which all machines
    share, and returns the manifest (also stored at <path>/manifest): file, records, bytes, sha256.

    Null html is an empty payload, a null url leaves out its header, a null page_id sorts first and is
    never referred to. Equal payloads of one page id stay together; the first of them by url is the
    response. An empty table writes no file and an empty manifest. The same rows make the same files. Rows
    equal in id, url and payload are one unit of a range; a payload larger than a range is a range itself.

    Payloads are shuffled once, straight into their range; what they refer to comes to them there in rows
    without payloads.
    """
    spark = pages.sparkSession
    rows = prepared(pages)
    slim = materialize(rows.select("page_id", "digest", "key", "mark", F.octet_length("payload").cast("bigint").alias("bytes")), "warc-slim")
    starts = range_starts(slim, range_bytes)
    notes = references(slim).withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    columns = ["page_id", "url", "payload", "digest", "refers_to", "key", "mark"]
    both = rows.withColumn("refers_to", F.lit(None).cast(slim.schema["page_id"].dataType)).select(columns).unionByName(notes.select(columns))
    # A range is a task; within one, what a payload refers to comes before its rows.
    dealt = both.withColumn("range", range_of(starts)).repartitionById(len(starts) + 1, "range")
    dealt = dealt.sortWithinPartitions("key", "mark", "page_id", "digest", F.col("payload").isNotNull(), "url", "payload").select("page_id", "url", "payload", "digest", "refers_to", "range")
    root = path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(root)
        fs.create_dir(folder, recursive=True)
        attempt, done, last, note = uuid.uuid4().hex, [], None, (None, None, None)
        out = at = None
        shard = 0

        def close() -> None:
            out.close()
            done.append((f"{at:06d}-{shard:05d}.warc.gz", name, records, size, sha.hexdigest()))

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, first, where = (c[i].as_py() for c in b.columns)
                if payload is None:
                    note = page, digest, first
                    continue
                first = note[2] if note[:2] == (page, digest) else None
                own = first is not None and first == page and (page, digest) != last
                last = (page, digest) if own else last
                data = gzip.compress(record(page, url, payload, digest, None if own else first), 6, mtime=0)
                if out is not None and (where != at or size >= roll_bytes):
                    close()
                    out, shard = None, shard + 1
                if out is None:
                    shard, at = (shard if where == at else 0), where
                    name, records, size, sha = f"tmp-{attempt}-{len(done)}", 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
                sha.update(data)
        if out is not None:
            close()
        columns = zip(*done, strict=True) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "temporary", "records", "bytes", "sha256"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(root)
        for b in batches:
            for row in b.to_pylist():
                old, new = f"{folder}/{row['temporary']}", f"{folder}/{row['file']}"
                if fs.get_file_info(old).type != pafs.FileType.NotFound:
                    fs.move(old, new)
                if fs.get_file_info(new).size != row["bytes"]:
                    raise OSError(f"{new} isn't whole")
            yield b.select(["file", "records", "bytes", "sha256"])

    written = materialize(dealt.mapInArrow(write, "file string, temporary string, records bigint, bytes bigint, sha256 string"), "warc-written")
    written.mapInArrow(commit, "file string, records bigint, bytes bigint, sha256 string").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def parse(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open gzipped WARC file: named fields in lower case, and the block."""
    f = gzip.GzipFile(fileobj=f)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = {}
        while (line := f.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            fields[key.decode().lower()] = value.strip().decode()
        yield fields, f.read(int(fields["content-length"]))


def read_archive(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """A row for each record of the archive: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload (null for revisits). Lengths and digests of responses are of the payload read, and
    must agree with the headers; those of revisits are the headers'. Files are streamed record by record."""
    root = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(root)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with fs.open_input_file(f"{folder}/{file}") as f:
                    for head, block in parse(f):
                        rows.append(row(file, head, block))
                        if len(rows) >= 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def row(file: str, head: dict[str, str], block: bytes) -> tuple:
        kind, digest, size, payload = head["warc-type"], head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"]), None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                raise ValueError(f"a payload in {file} doesn't fit its digest")
        return head.get("x-page-id"), head.get("warc-target-uri"), kind, size, digest, head.get("x-refers-to-page"), payload

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.parquet(f"{path}/manifest").select("file")
    spread = files.repartition(max(1, min(files.count(), READERS)))
    out = spread.mapInArrow(run, "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


#: What the archive of `pages` reads back as, in DuckDB's SQL.
SQL = f"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h)) n, sha256(h) digest from p),
f as (select *, case when n >= {DEDUP_BYTES} then min(page_id) over (partition by digest) end first from d)
select page_id, n::bigint payload_bytes, digest payload_digest, case when first < page_id then 'revisit' else 'response' end record_type, case when first < page_id then first end refers_to from f
"""
