"""Stateful operators: admission of calls, and records of a session as a stream."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import storage
from ..operators import memory, order

WINDOW_S, PER_ACTOR, OVERALL = 60.0, 8, 24


class Limiter:
    """Accepts a call if its actor has fewer than `per_actor` accepted calls within the window, and all
    actors fewer than `overall`. A call leaves the window exactly `window` seconds later; refused calls
    don't count."""

    def __init__(self, window: float = WINDOW_S, per_actor: int = PER_ACTOR, overall: int | None = OVERALL):
        self.window, self.per_actor, self.overall = window, per_actor, overall
        self.all: deque[tuple[float, object]] = deque()
        self.by: dict[object, int] = {}

    def accept(self, actor: object, now: float) -> bool:
        while self.all and now - self.all[0][0] >= self.window:
            _, gone = self.all.popleft()
            self.by[gone] -= 1
            if not self.by[gone]:
                del self.by[gone]
        if self.by.get(actor, 0) >= self.per_actor or self.overall is not None and len(self.all) >= self.overall:
            return False
        self.all.append((now, actor))
        self.by[actor] = self.by.get(actor, 0) + 1
        return True


def _decided(calls: DataFrame, keys: list[str], window: float, limits: tuple[int, int | None]) -> DataFrame:
    """id, actor, accepted of calls (id, actor, t), limited among those of equal keys.

    Whether a call is accepted depends on the ones before it, but no further back than a pause: where no call
    came for the window, none is left in it. So the calls fall into sessions that know nothing of each other,
    found by looking at the call before (over stored ranges, so no key is one task); sessions are spread over tasks,
    and each is streamed in order, in blocks, to a Python worker, whose memory holds one window. A key without pauses is
    one session, and one task."""
    gone = order.before(calls, keys, ["t", "id"], "_previous", "t")
    begins = (F.col("_previous").isNull() | (F.col("t") - F.col("_previous") >= window)).cast("bigint")
    numbered = order.running(gone.withColumn("_begins", begins), keys, ["t", "id"], "_session", F.col("_begins"))
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps AQE from joining them
    blocks = _blocks(order.ranged(numbered, keys, ["t", "id"]), keys)
    dealt = blocks.repartition(tasks, *keys, "_session").sortWithinPartitions(*keys, "_session", "t", "id")

    def together(parts: list[tuple]) -> pd.DataFrame:
        ids, names, seen = (list(chain.from_iterable(x)) for x in zip(*parts, strict=True))
        return pd.DataFrame({"id": ids, "actor": names, "accepted": seen})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, of, out, held = None, object(), [], 0
        for pdf in batches:
            for key, actors, numbers, ids, times in zip(zip(*(pdf[k] for k in (*keys, "_session")), strict=True), pdf["actors"], pdf["numbers"], pdf["ids"], pdf["times"], strict=True):
                if key != of:
                    limiter, of = Limiter(window, *limits), key
                names = [actors[n] for n in numbers]
                out.append((ids, names, [limiter.accept(a, t) for a, t in zip(names, times, strict=True)]))
                held += len(ids)
                if held >= 64 * BLOCK:
                    yield together(out)
                    out, held = [], 0
        if out:
            yield together(out)

    return dealt.mapInPandas(run, "id bigint, actor string, accepted boolean")


#: Calls of a session that travel as one row.
BLOCK = 1024


def _blocks(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls (keys, _session, id, actor, t) that each task has in order, up to BLOCK of a session as one row: the keys, t
    and id of the first, and arrays. A session that is one task's then holds some 20 bytes for each call while
    blocks are put in order, and a row for each BLOCK of them; a row for each call took about 100."""
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in dict.fromkeys([*keys, "_session"])), "t double, id bigint, actors array<string>, numbers array<int>, ids array<bigint>, times array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = (pdf[[*keys, "_session"]] != pdf[[*keys, "_session"]].shift()).any(axis=1).to_numpy()
            sessions = [*new.nonzero()[0].tolist(), len(pdf)]
            starts = [lo for a, b in pairwise(sessions) for lo in range(a, b, BLOCK)]
            own, rows = [pdf[k].to_numpy() for k in (*keys, "_session", "t", "id", "actor")], []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)], strict=True):
                *first, times, ids, actors = (c[lo:hi] for c in own)
                at = {x: i for i, x in enumerate(dict.fromkeys(actors))}
                rows.append([*(c[0] for c in first), times[0], ids[0], list(at), [at[x] for x in actors], ids, times])
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "_session", "t", "id", "actors", "numbers", "ids", "times"])

    return calls.select(*dict.fromkeys([*keys, "_session", "id", "actor", "t"])).mapInPandas(run, schema)


def _timed(calls: DataFrame, key: str) -> DataFrame:
    """id, actor, t of calls; calls without an actor are of the actor ""."""
    return calls.select("id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("actor"), F.col("ts").cast("timestamp").cast("double").alias("t"))


def limit_calls(calls: DataFrame, window: float = WINDOW_S, per_actor: int = PER_ACTOR, key: str = "actor") -> DataFrame:
    """calls (id, actor, ts) with accepted, under the limit of each actor. Sessions of an actor are tasks of
    their own (see `_decided`), so a hot actor is spread as well, as far as it pauses."""
    return _decided(_timed(calls, key), ["actor"], window, (per_actor, None))


def limit_all(calls: DataFrame, window: float = WINDOW_S, per_actor: int = PER_ACTOR, overall: int = OVERALL) -> DataFrame:
    """calls (id, actor, ts) with accepted, under both limits. Sessions are those of all calls together."""
    return _decided(_timed(calls, "actor"), [], window, (per_actor, overall))


class ActorLimit(StatefulProcessor):
    """The limit of each actor over a stream of (id, actor, ts): state is the accepted times of a window."""

    def __init__(self, window: float = WINDOW_S, per_actor: int = PER_ACTOR):
        self.window, self.per_actor = window, per_actor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [t for (t,) in self.times.get()]
        # A micro-batch of one actor may come in several pieces, in any order: all of it is put in order.
        pdf, seen = pd.concat(list(rows)).sort_values(["t", "id"]), []
        for t in pdf["t"]:
            held = [h for h in held if t - h < self.window]
            seen.append(len(held) < self.per_actor)
            held += [t] if seen[-1] else []
        yield pd.DataFrame({"id": pdf["id"], "actor": key[0], "accepted": seen})
        if held:
            self.times.put([(t,) for t in held])

    def close(self) -> None:
        pass


def limit_stream(calls: DataFrame, window: float = WINDOW_S, per_actor: int = PER_ACTOR) -> DataFrame:
    rows = calls.select("id", F.col("actor").cast("string").alias("actor"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return rows.groupBy("actor").transformWithStateInPandas(ActorLimit(window, per_actor), "id bigint, actor string, accepted boolean", "append", "none")


class SessionRecords(StatefulProcessor):
    """The last records of each session: state is a list of at most `keep` rows (seq, agent_id, terms, paths),
    which go `seconds` after the session's last record (0: never)."""

    FIELDS = "seq bigint, agent_id string, terms array<string>, paths array<string>"

    def __init__(self, keep: int = memory.KEPT_RECORDS, seconds: int = 0):
        self.keep, self.seconds = keep, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        more = {"ttlDurationMs": self.seconds * 1000} if self.seconds else {}
        self.held = handle.getListState("records", self.FIELDS, **more)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = {r[0]: tuple(r) for r in self.held.get()}
        for pdf in rows:  # a micro-batch may come in pieces; a record that is sent again is the same one
            for seq, agent, terms, hits in zip(pdf["seq"], pdf["agent_id"], pdf["terms"], pdf["hits"], strict=True):
                if hits is not None and len(hits):
                    held[int(seq)] = int(seq), agent, list(terms), list(hits)[: memory.KEPT_PATHS]
        kept = [held[s] for s in sorted(held)[-self.keep :]]
        if kept:
            self.held.put(kept)
            out = pd.DataFrame(kept, columns=["seq", "agent_id", "terms", "paths"])
            yield out.assign(session_id=key[0])[["session_id", "seq", "agent_id", "terms", "paths"]]

    def close(self) -> None:
        pass


def remember_stream(queries: DataFrame, keep: int = memory.KEPT_RECORDS, seconds: int = 0) -> DataFrame:
    """`memory.remember` over a stream of queries (seq, session_id, agent_id, terms, hits): for each session that
    a micro-batch touches, its last `keep` records (session_id, seq, agent_id, terms, paths). Queries without
    hits aren't remembered."""
    rows = queries.withColumn("session_id", F.coalesce("session_id", F.lit(memory.LEGACY)))
    return rows.groupBy("session_id").transformWithStateInPandas(SessionRecords(keep, seconds), f"session_id string, {SessionRecords.FIELDS}", "update", "processingTime" if seconds else "none")


def run_available(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode over what there is, and returns for each key the row of the last micro-batch
    that gave one: a table in the shared folder, where the checkpoint is as well."""
    spark = stream.sparkSession
    root = f"{storage.shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    write = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/{number}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch bigint").option("recursiveFileLookup", "true").parquet(f"{root}/rows")
    columns = [c for c in rows.columns if c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_row")).select("_row.*")


def upsert_by_path(path: str, sequence: str | None = None, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table of the newest row of each path: that of the greatest
    `sequence` (of rows equal in it, and without one, the greatest by all columns). Each batch writes a version of
    its own, so a batch that is run again writes the same one; the last `keep` versions stay."""

    def apply(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        every = batch
        if number:
            every = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        else:
            every = batch.withColumn("_new", F.lit(1))
        # Without a sequence, a row of the batch is newer than one of the table.
        rank = F.struct(*([sequence] if sequence else []), F.coalesce("_new", F.lit(0)).alias("_new"), *(F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)))
        newest = every.groupBy("path").agg(F.max_by(F.struct(*columns), rank).alias("_row")).select("_row.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number >= keep:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - keep}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return apply
