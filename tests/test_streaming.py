import pytest
from pyspark.sql import functions as F

from sourcelens.streaming import limiter


def test_upsert(spark, tmp_path):
    apply = limiter.upsert_by_path(f"file://{tmp_path}/index")
    rows = lambda *r: spark.createDataFrame(r, "path string, n int")
    apply(rows(("a", 1), ("b", 1)), 0)
    apply(rows(("b", 2), ("c", 2)), 1)
    apply(rows(("b", 2), ("c", 2)), 1)  # a batch that is run again
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/index/v1").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_actor_limit_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "calls")
    calls = spark.range(20).select("id", F.when(F.col("id") < 12, "a").otherwise("b").alias("actor"), F.timestamp_seconds(F.col("id")).alias("ts"))
    calls.write.parquet(source)
    stream = limiter.limit_stream(spark.readStream.schema(calls.schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["actor"]: r["n"] for r in spark.table("admitted").where("accepted").groupBy("actor").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 8, "b": 8}


def test_pieces_of_a_batch_are_put_in_order():
    import pandas as pd

    class State:
        def __init__(self):
            self.kept = []

        def get(self):
            return iter(self.kept)

        def put(self, rows):
            self.kept = rows

    p = limiter.ActorLimit(window=60.0, per_actor=2)
    p.times = State()
    pieces = [pd.DataFrame({"t": [100.0, 30.0], "id": [4, 2]}), pd.DataFrame({"t": [10.0, 20.0], "id": [0, 1]})]
    got = pd.concat(list(p.handleInputRows(("a",), iter(pieces), None)))
    assert dict(zip(got["id"], got["accepted"])) == {0: True, 1: True, 2: False, 4: True}
    assert p.times.kept == [(100.0,)]


def one_by_one(calls, window, per_actor, overall):
    """Every call in order through one limiter of each kind."""
    limiters, out = {}, {}
    for i, actor, t in sorted(calls, key=lambda c: (c[2], c[0])):
        key = actor if overall is None else None
        out[i] = limiters.setdefault(key, limiter.Limiter(window, per_actor, overall)).accept(actor, t)
    return out


def test_sessions_are_the_sequential_limiter(spark):
    """A hot actor, bursts, pauses of just the window and just less, equal times, no actor at all."""
    import random

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("actor", T.StringType()), T.StructField("ts", T.DoubleType())])
    for seed in range(4):
        rng, t, calls = random.Random(seed), 0.0, []
        for i in range(1500):
            t += rng.choice([0, 0, 0.5, 1, 9.75, 10, 11])
            calls.append((i, rng.choice(["hot"] * 6 + ["b", "c", ""]), t))
        df = spark.createDataFrame(rng.sample(calls, len(calls)), schema).withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("bigint"))).repartition(5)
        for run, limits in ((limiter.limit_calls, (3, None)), (limiter.limit_all, (3, 5))):
            got = run(df, 10.0, 3, **({} if limits[1] is None else {"overall": 5}))
            assert {r["id"]: r["accepted"] for r in got.collect()} == one_by_one(calls, 10.0, *limits)
    many = limiter.limit_all(df, 10.0, 3, 5)
    assert many.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    assert limiter.limit_all(df.where("id < 0")).count() == 0


def test_records_of_a_session_as_a_stream(spark, tmp_path):
    """Micro-batches, records sent twice, none without hits; the last of each session as the batch form keeps them."""
    from sourcelens.operators import memory

    source, schema = str(tmp_path / "q"), "seq bigint, session_id string, agent_id string, terms array<string>, hits array<string>"
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", "a", ["t"], [] if i % 4 == 0 else [f"p{k}" for k in range(12)]) for i in range(60)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 25], schema).coalesce(1).write.mode("append").parquet(source)
    stream = limiter.remember_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), keep=6)
    got = {}
    newest = limiter.run_available(stream, "records", ["session_id", "seq"]).collect()
    for r in newest:
        got.setdefault(r["session_id"], []).append((r["seq"], tuple(r["paths"])))
    df = spark.createDataFrame(rows, schema)
    for session in ("s0", "s1", "s2", memory.LEGACY):
        own = df.where(F.coalesce("session_id", F.lit(memory.LEGACY)) == session)
        want = memory.remember(own.select("seq", "session_id", "agent_id", "terms", F.col("hits").alias("paths")).where("false"), own).orderBy("seq").collect()[-6:]
        assert sorted(got[session])[-6:] == [(r["seq"], tuple(r["paths"])) for r in want]


def test_upsert_takes_the_newest_row(spark, tmp_path):
    apply = limiter.upsert_by_path(f"file://{tmp_path}/index", "seq")
    rows = lambda *r: spark.createDataFrame(r, "path string, seq int, n int").repartition(3)
    apply(rows(("a", 5, 50), ("a", 7, 70), ("a", 6, 60), ("b", 1, 10)), 0)
    apply(rows(("a", 4, 40), ("b", 3, 30), ("b", 2, 20), ("c", 1, 1)), 1)
    apply(rows(("d", 1, 1)), 2)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/index/v2").collect())) == [("a", 7, 70), ("b", 3, 30), ("c", 1, 1), ("d", 1, 1)]
    assert not (tmp_path / "index/v0").exists()


def test_row_before(spark):
    from sourcelens.operators import order

    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "k int, x int").repartition(6)
    got = {r["x"]: r["was"] for r in order.before(df, ["k"], ["x"], "was", "x").collect()}
    last, want = {}, {}
    for i in range(200):
        k = i % 3 if i % 7 else None
        want[i] = last.get(k)
        last[k] = i
    assert got == want
