"""Queries answered from a stored index that grows with them, in rounds of doubling byte budgets."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.redact import redact_udf
from ..operators import adaptive, policy, rank
from ..storage import discard, stored
from .context import HIT, Answers, Found
from .stored_index import StoredIndex

#: Queries whose verified candidates are kept.
KEPT_QUERIES = 32


@dataclass
class _Verified:
    """Candidates that were read and checked against the query, over its rounds: stored tables, and the driver's
    list of path and stamp (at most the candidate limit a round)."""

    tables: list[DataFrame] = field(default_factory=list)
    stamps: dict[str, str] = field(default_factory=dict)


@dataclass
class _Round:
    """What rounds of one query hand on. listed: the searchable files (path, length, stamp; stored)."""

    listed: DataFrame
    excluded: int
    cut: bool
    verified: _Verified
    used: dict = field(default_factory=lambda: {"scanned_files": 0, "scanned_bytes": 0})


class IndexedEngine(Answers):
    """Queries over a source (sources.corpora) and its index.

    Each query lists the files, drops what an earlier read has shown to be excluded, and compares stamps with
    the index. A round then reads missing and changed files within three quarters of its bytes, lane by lane,
    and brings the index up to date; ranks by the index; and reads candidates within the other quarter to find
    their evidence. Rounds double what is granted until nothing is left to read, the answer is sure enough, or
    the cap is reached. Candidates verified in earlier rounds, or by an earlier query of the same words, at the
    same stamp cost nothing. So a query over an unchanged corpus reads its candidates only, and the same one
    again reads nothing.

    Queries may overlap; updates of the index run one at a time.
    """

    def __init__(self, spark: SparkSession, source, index: StoredIndex, first: int = adaptive.FIRST_ROUND, cap: int = adaptive.LAST_ROUND):  # noqa: ANN001
        super().__init__(spark)
        self.source, self.index, self.first, self.cap = source, index, first, cap
        self._kept: dict[tuple, _Verified] = {}
        self._writing = threading.Lock()

    def find(self, query: Q.Query, session: str | None = None, agent: str | None = None, check: Callable[[], None] = lambda: None, done: Callable[[Found], None] = lambda _: None) -> Found:
        found = self._listed(query)
        held = {"granted": 0, "rounds": 0, "found": None}

        def run(budget: int) -> adaptive.Round:
            check()
            got, expandable = self.search_once(query, found, budget - held["granted"], session, agent)
            held.update(granted=budget, rounds=held["rounds"] + 1, found=got)
            got.coverage |= {"rounds": held["rounds"], "budget": budget, "cap": self.cap}
            done(got)
            return adaptive.Round(budget, got.confidence, got.truncated, expandable)

        adaptive.adapt(run, self.cap, self.first)
        with self.lock:
            key = (query.raw, query.terms)
            self._kept.pop(key, None)
            self._kept[key] = found.verified
            while len(self._kept) > KEPT_QUERIES:
                self._kept.pop(next(iter(self._kept)))  # its tables stay for queries that still read them
        return held["found"]

    def _listed(self, query: Q.Query) -> _Round:
        """Discovery: what may be searched, less the generations remembered as skips."""
        files, cut = self.source.files()
        skips = self.index.skips().select("path", "stamp", F.col("reason").alias("skipped"))
        files = stored(files.join(skips, ["path", "stamp"], "left"), "listed")
        failed = policy.makes_incomplete(F.col("reason"))
        why = files.agg(F.count_if((F.col("reason").isNotNull() & ~failed) | (F.col("reason").isNull() & F.col("skipped").isNotNull())).alias("excluded"), F.count_if(failed).alias("failed")).first()
        with self.lock:
            kept = self._kept.get((query.raw, query.terms), _Verified())
        verified = _Verified(list(kept.tables), dict(kept.stamps))
        return _Round(files.where("reason is null and skipped is null").select("path", "length", "stamp"), why["excluded"], cut or why["failed"] > 0, verified)

    def changed_since(self, found: Found) -> set[str]:
        """Hits (at most 32) whose file has another stamp than the one that was listed. Stamps alone are looked at."""
        if not found.hits:
            return set()
        now = self.source.stamps([h["path"] for h in found.hits])
        return {h["path"] for h in found.hits if now.get(h["path"]) != found.stamps.get(h["path"])}

    # --- One round. ---
    def search_once(self, query: Q.Query, state: _Round, budget: int, session: str | None = None, agent: str | None = None) -> tuple[Found, bool]:
        """What is found with `budget` more bytes, and whether a larger budget could find more. What was read
        and verified is added to the state."""
        terms, (k, _) = list(query.terms), Q.result_limits(len(query.terms))
        limit = Q.candidate_limit(k)
        for_index, for_texts, for_priority, for_sample = adaptive.split_budget(budget)
        incomplete = self._grow(state, terms, for_index, for_priority, for_sample)

        # Statistics of the indexed files among those listed, observed while the matches are stored.
        n, seen = len(terms), Observation()
        docs = self.index.documents().select("path", F.col("dl").alias("own_dl"), F.col("truncated").alias("partial"))
        every = state.listed.join(docs, "path", "left").join(self.index.frequencies(terms).drop("dl"), "path", "left")
        every = every.withColumns({f"tf{i}": F.coalesce(f"tf{i}", F.lit(0)) for i in range(n)} | {"path_bonus": rank.path_score(F.col("path"), terms)})
        known = F.col("own_dl").isNotNull()
        counted = every.observe(
            seen, F.count("*").alias("eligible"), F.count_if(known).alias("n_docs"), F.avg("own_dl").alias("avgdl"), F.count_if(F.col("partial")).alias("partial"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n))
        )
        content = rank.matched(n) > 0
        matches = stored(counted.where(content | (F.col("path_bonus") > 0)).withColumn("dl", F.coalesce("own_dl", F.lit(1))), "index-matches")
        stats = {c: v if v is not None else 1.0 for c, v in seen.get.items()}
        literal = lambda df: df.withColumns({c: F.lit(stats[c]) for c in ("n_docs", "avgdl", *(f"df{i}" for i in range(n)))})

        scored = self.with_adjustment(rank.with_scores(literal(matches.select("path", "length", "stamp", "dl", *(f"tf{i}" for i in range(n)))), terms), terms, session, agent)
        move = F.when(F.col("matched") > 0, F.col("adjustment")).otherwise(F.least("adjustment", F.lit(4.0)))
        best = rank.cut(scored.withColumn("score", F.col("score") + move), limit)
        ranked = best.select("path", "length", "stamp", "path_bonus", "adjustment", "score", (F.col("matched") > 0).alias("content"), "beyond").orderBy(F.desc("score"), "path").collect()
        unread = self._verify(query, terms, state, [r for r in ranked if r["content"]], for_texts)

        candidates = self.spark.createDataFrame([tuple(r) for r in ranked], "path string, length bigint, stamp string, path_bonus int, adjustment double, score double, content boolean, beyond boolean")
        hits = self._hits(query, candidates, state.verified, terms, literal, k)
        cut = bool(ranked) and ranked[0]["beyond"]
        discard(matches)
        left = stats["n_docs"] < stats["eligible"] or stats["partial"] > 0
        expandable = state.cut or incomplete or unread or self.index.manifest.saturated or left
        cover = {
            "files": stats["eligible"] + state.excluded, "excluded": state.excluded, "indexed": stats["n_docs"], "eligible": stats["eligible"], "partial": stats["partial"], "complete": not left and not state.cut,
            "percent": 100 * stats["n_docs"] // stats["eligible"] if stats["eligible"] else 100, **state.used,
        }
        texts = self._texts(state.verified)
        found = Found.of(hits, texts, cover, cut or expandable, terms)
        found.stamps = {r["path"]: r["stamp"] for r in ranked}
        return found, expandable

    def _grow(self, state: _Round, terms: list[str], budget: int, priority: int, sample: int) -> bool:
        """Reads missing and changed files into the index, and drops deleted ones; whether a read failed."""
        with self._writing:
            states = stored(self.index.states(state.listed, not state.cut), "states")
            counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
            if not {*counts} & {"missing", "changed", "deleted"}:
                discard(states)
                return False
            pending = state.listed.join(states.where("state in ('missing', 'changed')"), "path")
            files = pending.select("path", "length", "stamp", rank.path_score(F.col("path"), terms).alias("path_bonus"), (F.col("state") == "changed").alias("changed"))
            laned = stored(adaptive.lanes(files, "length", counts.get("missing", 0) + counts.get("changed", 0)), "laned")
            chosen, used = [], 0
            for lane, most in (("priority", priority), ("sample", sample), ("broad", budget)):
                fit, size = adaptive.fit_lane(laned.where(F.col("lane") == lane), min(most, budget - used))
                used += size
                chosen.append(fit.select("path", "lane", "place", F.col("stamp").alias("listed_stamp")))
            order = F.when(F.col("lane") == "priority", 0).when(F.col("lane") == "sample", 1).otherwise(2).cast("bigint") * (1 << 40) + F.col("place")
            wanted = stored(reduce(lambda a, b: a.unionByName(b), chosen).select("path", "listed_stamp", order.alias("place")), "chosen")
            texts = self.source.texts(wanted)
            # A text of another generation than the one listed isn't indexed: it's listed anew next time.
            read = stored(texts.join(wanted, "path").withColumn("moved", F.col("reason").isNull() & ~F.col("stamp").eqNullSafe(F.col("listed_stamp"))), "read")
            n, size, failed, skipped = read.agg(F.count_if(F.col("text").isNotNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("moved") | policy.makes_incomplete(F.col("reason"))), F.count_if(F.col("reason").isNotNull() & ~policy.makes_incomplete(F.col("reason")))).first()
            self.index.update(states, read.where("not moved"), again=False)
        state.used["scanned_files"] += n
        state.used["scanned_bytes"] += size
        if skipped:  # what was just learnt to be excluded by policy is no longer searchable
            gone = self.index.skips().select("path", "stamp")
            state.listed, state.excluded = stored(state.listed.join(gone, ["path", "stamp"], "left_anti"), "listed"), state.excluded + skipped
        for table in (wanted, laned, read, states):
            discard(table)
        return failed > 0

    def _verify(self, query: Q.Query, terms: list[str], state: _Round, ranked: list, budget: int) -> bool:
        """Reads the candidates (rows path, length, stamp; best first) that aren't verified at their stamp, while
        they fit the budget, and finds their evidence; whether some were left out."""
        verified, chosen, used, left = state.verified, [], 0, False
        for r in ranked:
            if verified.stamps.get(r["path"]) == r["stamp"]:
                continue
            if used + r["length"] <= budget:
                used += r["length"]
                chosen.append((r["path"], r["stamp"]))
            else:
                left = True
        if not chosen:
            return left
        n = len(terms)
        wanted = self.spark.createDataFrame(chosen, "path string, listed_stamp string")  # at most the candidate limit
        texts = self.source.texts(wanted).join(F.broadcast(wanted), "path").where("reason is null and text is not null and stamp <=> listed_stamp")
        own = rank.term_statistics(texts.withColumn("fingerprint", F.sha2("text", 256)), terms, ("stamp", "fingerprint", "text"))
        safe = stored(own.withColumn("text", redact_udf("text")), "candidates")
        evidence = rank.evidence(safe, query.raw, terms).select("path", "start_line", "end_line", "excerpt", "exact", "structure")
        table = stored(safe.join(evidence, "path", "left").select("path", "stamp", "fingerprint", "text", "dl", *(f"tf{i}" for i in range(n)), "start_line", "end_line", "excerpt", "exact", "structure"), "verified")
        discard(safe)
        got = table.select("path", "stamp", F.octet_length("text")).collect()
        verified.tables.append(table)
        verified.stamps.update((r["path"], r["stamp"]) for r in got)
        state.used["scanned_files"] += len(got)
        state.used["scanned_bytes"] += used
        return left or len(got) < len(chosen)

    def _texts(self, verified: _Verified) -> DataFrame | None:
        parts = [t.select("path", "stamp", "text", "fingerprint") for t in verified.tables]
        if not parts:
            return None
        now = self.spark.createDataFrame(list(verified.stamps.items()), "path string, stamp string")
        return reduce(lambda a, b: a.unionByName(b), parts).join(F.broadcast(now), ["path", "stamp"]).dropDuplicates(["path"])

    def _hits(self, query: Q.Query, candidates: DataFrame, verified: _Verified, terms: list[str], literal: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
        """The k best hits. Content matches count once they are verified, by their own frequencies and today's
        statistics; those that the text doesn't bear out count by their path alone."""
        n = len(terms)
        nowhere = candidates.where("not content").select("path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("").alias("excerpt"), "score", F.lit(None).cast("string").alias("fingerprint"))
        if not verified.tables:
            return rank.top(nowhere.select(*HIT), k, "start_line")
        rows = reduce(lambda a, b: a.unionByName(b), verified.tables).drop("text").dropDuplicates(["path", "stamp"])
        own = candidates.where("content").select("path", "stamp", "path_bonus", "adjustment")
        rows = literal(rows.join(F.broadcast(own), ["path", "stamp"]))
        found, visible = rank.matched(n), F.col("start_line").isNotNull()
        base = rank.CONTENT_BASE + 10 * found + 3 * F.col("path_bonus") + 12 * rank.bm25(n) + F.col("adjustment")
        score = F.when(found == 0, 3.0 * F.col("path_bonus")).when(visible, base + 8 * F.col("exact") + F.col("structure")).otherwise(base)
        excerpt = F.when(found == 0, "").when(visible, F.col("excerpt")).otherwise(rank.WITHHELD)
        shown = rows.where((found > 0) | (F.col("path_bonus") > 0)).select("path", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), excerpt.alias("excerpt"), score.alias("score"), "fingerprint")
        return rank.top(shown.unionByName(nowhere).select(*HIT), k, "start_line")
