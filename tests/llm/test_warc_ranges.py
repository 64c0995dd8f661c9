"""Ranges of the archive writer: any ids, any sizes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelens.llm import common, warc

SCHEMA = "page_id bigint, url string, html string"


def sizes(spark, pages, range_bytes):
    """Payload bytes of each range, in order."""
    rows = warc.prepared(pages)
    slim = common.materialize(rows.select("page_id", "digest", "key", "mark", F.octet_length("payload").cast("bigint").alias("bytes")), "slim")
    starts = warc.range_starts(slim, range_bytes)
    got = rows.select(warc.range_of(starts).alias("r"), F.octet_length("payload").alias("n"), "key", "mark").collect()
    want = [int(np.sum([(r["key"], r["mark"]) >= s for s in starts])) for r in got]
    assert [r["r"] for r in got] == want
    out = {}
    for r in got:
        out[r["r"]] = out.get(r["r"], 0) + r["n"]
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("odd", [[], [1 << 60], [-(1 << 63), (1 << 63) - 1], [None] * 3])
def test_outliers_do_not_merge_ranges(spark, odd):
    pages = spark.createDataFrame([(i, "u", "x" * 1000) for i in [*range(400), *odd]], SCHEMA)
    got = sizes(spark, pages, 10_000)
    assert sum(got) == 1000 * (400 + len(odd)) and max(got) <= 11_000 and len(got) >= 39


@pytest.mark.parametrize("page", [7, None])
def test_one_id_is_split(spark, page):
    pages = spark.createDataFrame([(page, f"u{i}", f"{i:04d}" * 250) for i in range(300)], SCHEMA)
    got = sizes(spark, pages, 10_000)
    assert sum(got) == 300_000 and max(got) <= 11_000


def test_most_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_RANGES", 5)
    pages = spark.createDataFrame([(i, "u", "x" * 1000) for i in range(100)], SCHEMA)
    assert len(sizes(spark, pages, 10)) <= 6


def test_long_payloads_and_copies(spark):
    """A payload larger than a range and a file, and copies of it spread over ranges."""
    long = "é" * 400_000
    rows = [(1, "a", "short"), (5, "b", long), (9, "c", long), (9, "d", long), (1 << 50, "e", long), (None, "f", long), *((100 + i, "g", "y" * 2000) for i in range(50))]
    path = common.shared_path(spark, "warc-long")
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, roll_bytes=1000, range_bytes=20_000)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    digest = hashlib.sha256(long.encode()).hexdigest()
    of = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest), key=str)
    assert of == sorted([(5, "response", None), (9, "revisit", 5), (9, "revisit", 5), (1 << 50, "revisit", 5), (None, "revisit", 5)], key=str)
    assert [r["payload_bytes"] for r in got if r["page_id"] == 5] == [800_000]
    assert [r["record_type"] for r in got if r["page_id"] and 100 <= r["page_id"] < 200].count("response") == 1
