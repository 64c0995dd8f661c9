"""The whole query: from a few words to a pack of ranked, redacted excerpts and a structural map."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.redact import redact_udf
from ..functions.text import compact
from ..operators import adaptive, graph, memory, pack, policy, rank, symbols
from ..storage import stored
from .cache import StampCache
from .calls import Calls, Cancelled, DeadlineExceeded

MAP_FILES = 16
COLUMNS = ("seq bigint", "session_id string", "agent_id string", "terms array<string>", "paths array<string>")
HIT = ["path", "start_line", "end_line", "excerpt", "score", "fingerprint"]
FACTS = "fact string, name string, kind string, line int, signature string"


@dataclass
class Context:
    """What a query returns. hits: path, start_line, end_line, excerpt, score, fingerprint. truncated: there may
    be more than was looked at. late: the deadline came first, and this is the last round that had ended."""

    hits: list[dict]
    confidence: float
    text: str
    coverage: dict
    truncated: bool = False
    late: bool = False


@dataclass
class Found:
    """What a search, or a round of one, has found. bodies: the hits' excerpts as they are shown. texts: path,
    text (redacted), fingerprint of the candidates. stamps: those of the candidates' files when they were listed."""

    hits: list[dict]
    bodies: dict[str, str]
    texts: DataFrame | None
    coverage: dict
    truncated: bool
    confidence: float
    stamps: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, texts: DataFrame | None, coverage: dict, truncated: bool, terms: list[str]) -> Found:
        """From the hits' rows, best first."""
        got = rows.withColumn("body", compact(F.col("excerpt"))).collect()
        hits = [{c: r[c] for c in HIT} for r in got]
        sure = adaptive.confidence_of(hits, terms, coverage["indexed"], coverage["eligible"], truncated, coverage["excluded"])
        return cls(hits, {r["path"]: r["body"] for r in got}, texts, coverage, truncated, sure)

    def without(self, gone: set[str]) -> Found:
        """The same, less hits that were invalidated: there may then be more to find."""
        hits = [h for h in self.hits if h["path"] not in gone]
        return replace(self, hits=hits, coverage=self.coverage | {"invalidated": len(self.hits) - len(hits)}, truncated=True)


class Answers:
    """What engines share: memory, map, pack, and calls in flight. Several calls may run at once: what one has
    found is its own, and what they share is changed under a lock."""

    def __init__(self, spark: SparkSession):
        self.spark, self.calls, self.graphs = spark, Calls(), graph.GraphCache()
        self.facts = StampCache(spark, "facts", FACTS)
        #: Records as rows of COLUMNS, the newest last, at most memory.KEPT_RECORDS; files parsed so far.
        self.records, self.seq, self.parsed, self.lock = [], 0, 0, threading.Lock()

    @property
    def memory(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.records), ", ".join(COLUMNS))

    def with_adjustment(self, rows: DataFrame, terms: list[str], session: str | None, agent: str | None) -> DataFrame:
        """rows (path, ..) with adjustment, what the session's memory says of the path."""
        if not self.records:
            return rows.withColumn("adjustment", F.lit(0.0))
        # At most 1024 paths: eight for each of 128 records.
        moves = F.broadcast(memory.adjustments(self.memory, terms, session, agent))
        return rows.join(moves, "path", "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0)))

    def remember(self, session: str | None, agent: str | None, terms: list[str], hits: list[dict]) -> None:
        with self.lock:
            self.seq += 1
            if hits:
                record = self.seq, session or memory.LEGACY, agent, terms, [h["path"] for h in hits[: memory.KEPT_PATHS]]
                self.records = [*self.records, record][-memory.KEPT_RECORDS :]

    def find(self, query: Q.Query, session: str | None = None, agent: str | None = None, check: Callable[[], None] = lambda: None, done: Callable[[Found], None] = lambda _: None) -> Found:
        """What the query finds. Calls done with what there is whenever there is something to answer with."""
        raise NotImplementedError

    def changed_since(self, found: Found) -> set[str]:
        """Paths of hits whose source is no longer the one that was searched; they aren't shown."""
        return set()

    def _facts_of(self, files: DataFrame) -> DataFrame:
        """path, stamp and FACTS of files (path, text, stamp: a stored table), parsed where the cache lacks them."""
        known, missing = self.facts.probe(files.select("path", "stamp"))
        n = missing.count()
        if not n:
            return known
        texts = stored(files.join(missing, ["path", "stamp"], "left_semi"), "parse")
        facts = stored(symbols.syntax_facts(texts), "syntax")
        found = symbols.with_signatures(symbols.combined_symbols(facts.where("fact = 'symbol'"), symbols.heuristic_symbols(texts)), texts)
        rows = found.select("path", F.lit("symbol").alias("fact"), "name", "kind", "line", "signature")
        blank = F.lit(None).cast("string")
        rows = rows.unionByName(facts.where("fact = 'reference'").select("path", "fact", "name", "kind", "line", blank.alias("signature")))
        rows = rows.unionByName(symbols.import_paths(texts).select("path", F.lit("import").alias("fact"), F.col("module").alias("name"), blank.alias("kind"), F.lit(None).cast("int").alias("line"), blank.alias("signature")))
        new = self.facts.put(texts.select("path", "stamp"), rows.join(texts.select("path", "stamp"), "path"))
        with self.lock:
            self.parsed += n
        return known.unionByName(new)

    def structural_map(self, found: Found, terms: list[str], limit: int) -> list[tuple[str, float, list[str], list[tuple[str, str, float]]]]:
        """Map entries of at most 16 files that the search hit: path, score, symbols, links."""
        top = [h for h in found.hits if h["fingerprint"] is not None][: min(limit, MAP_FILES)]
        if not top or found.texts is None:
            return []
        paths = [h["path"] for h in top]
        files = stored(found.texts.where(F.col("path").isin(paths)).select("path", "text", F.col("fingerprint").alias("stamp")).coalesce(1), "map")
        facts = stored(self._facts_of(files).coalesce(1), "map-facts")
        refs = facts.where("fact = 'reference'").select("path", "name", "kind")
        key = tuple(sorted((h["path"], h["fingerprint"]) for h in top))
        with self.lock:
            kept = self.graphs.get(key)
        if kept is None:
            found_symbols, imports = facts.where("fact = 'symbol'").select("path", "name"), facts.where("fact = 'import'").select("path", F.col("name").alias("module"))
            edges = graph.reference_edges(refs, found_symbols).unionByName(graph.import_edges(imports, files)).unionByName(graph.lexical_edges(files, found_symbols))
            rows = graph.best_edges(edges).collect()
            order = {p: i for i, p in enumerate(sorted(paths))}
            ranks = graph.pagerank_small(len(order), [(order[r["src"]], order[r["dst"]], r["weight"]) for r in rows])
            kept = rows, {p: ranks[i] for p, i in order.items()}
            with self.lock:
                self.graphs.put(key, kept)
        rows, central = kept
        bonus = {r["path"]: r["bonus"] for r in graph.semantic_bonus(refs, terms).collect()}
        names: dict[str, list] = {}
        for r in symbols.ranked_symbols(facts.where("fact = 'symbol'").select("path", "name", "kind", "line", "signature"), terms).orderBy("path", "rank").collect():
            names.setdefault(r["path"], []).append(f"{r['kind']} {r['name']} {r['line']}")
        out = []
        for h in top:
            p = h["path"]
            links = sorted(((r["dst"], r["kind"], r["weight"]) for r in rows if r["src"] == p), key=lambda x: (-x[2], x[0]))[:6]
            out.append((p, h["score"] + 3 * bonus.get(p, 0.0) + 50 * central[p], names.get(p, []), links))
        return sorted(out, key=lambda e: (-e[1], e[0]))

    def cancel(self, request: str) -> bool:
        """Whether this ended the call in flight of that request; its `context` then raises Cancelled."""
        return self.calls.cancel(request)

    def context(self, q: str, session_id: str | None = None, agent_id: str | None = None, request: str | None = None, seconds: float | None = None) -> Context:
        """Answers q (one to eight terms). Raises QueryError for what isn't a query, and Cancelled if another
        thread ends the call. If there is no answer within `seconds`, the last round that had ended is the answer,
        without a map and flagged `late` and `truncated`; DeadlineExceeded is raised only if none had. A call that
        is late or cancelled isn't remembered."""
        query = Q.normalize(q)
        session, agent = Q.coordination(session_id, agent_id)
        terms, (_, n_map) = list(query.terms), Q.result_limits(len(query.terms))
        call, rounds = self.calls.begin(self.spark, request, seconds), []
        try:
            with call:
                found = self.find(query, session, agent, call.check, rounds.append)
                rounds.append(found)
                call.check()
                entries = self.structural_map(found, terms, n_map)
                call.check()
                if gone := self.changed_since(found):
                    found, entries = found.without(gone), [(p, score, names, [x for x in links if x[0] not in gone]) for p, score, names, links in entries if p not in gone]
                    call.check()
                answer = self._pack(found, terms, entries)
                if call.commit():
                    self.remember(session, agent, terms, found.hits)
        except DeadlineExceeded:
            if not rounds:
                raise
            answer = self._pack(rounds[-1], terms, [], late=True)
        finally:
            self.calls.end(call)
        return answer

    def _pack(self, found: Found, terms: list[str], entries: list, late: bool = False) -> Context:
        """The answer, on the driver: at most 24 hits and 16 entries."""
        cover, cut, scores = found.coverage, found.truncated or late, {e[0]: e[1] for e in entries}
        excerpts = [pack.Excerpt(h["path"], h["start_line"], h["end_line"], found.bodies[h["path"]].rstrip("\n"), scores.get(h["path"], h["score"])) for h in found.hits]
        tokens, size = Q.TIERS[Q.tier(found.confidence, len(excerpts), len(entries), len(terms))]
        head = f"[UNTRUSTED SOURCE EXCERPTS]\nCONTEXT {' '.join(terms)} confidence {found.confidence:.3f}\nCOVERAGE {cover['percent']}% of {cover['eligible']} files, {cover['excluded']} excluded\n"
        block = pack.structure(entries, min(max(size // 4, 2200), 6000))
        tail = Q.status(len(found.hits), cut, cover["excluded"])
        used = len((head + block + tail).encode()) + 16
        body = pack.render(excerpts, tokens - Q.estimated_tokens(head + block), size - used)
        return Context(found.hits, found.confidence, Q.prefix(f"{head}{block}EVIDENCE\n{body}{tail}", size), cover, cut, late)


class Engine(Answers):
    """Queries over one corpus (path, text; a `reason` column marks rows that policy excludes or that couldn't
    be read), all of which is read for each. truncated: the corpus is known not to be all there is."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, apply_policy: bool = True, truncated: bool = False):
        super().__init__(spark)
        self.truncated = truncated
        audited = corpus if "reason" in corpus.columns else policy.with_reason(corpus) if apply_policy else corpus.withColumn("reason", F.lit(None).cast("string"))
        self.audit, self.corpus = audited, audited.where(F.col("reason").isNull() & F.col("text").isNotNull()).select("path", "text")

    def search(self, q: Q.Query, session: str | None = None, agent: str | None = None) -> DataFrame:
        """The query's hits, best first: HIT."""
        return self._searched(q, session, agent)[0]

    def _searched(self, q: Q.Query, session: str | None, agent: str | None) -> tuple[DataFrame, DataFrame]:
        """The hits, and the candidates' texts (with `beyond`: matches were left out as there were too many).

        One pass over the texts finds the matches and the statistics of all documents; a second one fetches
        the candidates' texts, which are redacted and stored. Evidence is found in what redaction leaves."""
        terms, (k, _) = list(q.terms), Q.result_limits(len(q.terms))
        limit = Q.candidate_limit(k)
        scored = self.with_adjustment(rank.with_scores(rank.matches(self.corpus, terms), terms), terms, session, agent)
        move = F.when(F.col("matched") > 0, F.col("adjustment")).otherwise(F.least("adjustment", F.lit(4.0)))
        best = rank.cut(scored.withColumn("score", F.col("score") + move).select("path", "matched", "path_bonus", "bm25", "adjustment", "score"), limit)
        # `limit` rows: the texts of the candidates alone are redacted.
        texts = self.corpus.join(F.broadcast(best), "path").withColumn("fingerprint", F.sha2("text", 256)).withColumn("text", redact_udf("text"))
        texts = stored(texts, "candidates")
        seen = rank.evidence(texts, q.raw, terms, ("fingerprint", "matched", "path_bonus", "bm25", "adjustment", "score"))
        visible = seen.withColumn("score", F.col("score") + 8 * F.col("exact") + F.col("structure"))
        shown = visible.select(*HIT)
        rest = texts.join(shown.select("path"), "path", "left_anti")
        body = F.when(F.col("matched") > 0, F.lit(rank.WITHHELD)).otherwise("")
        bare = rest.select("path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), body.alias("excerpt"), "score", "fingerprint")
        return rank.top(shown.unionByName(bare.select(*HIT)), k, "start_line"), texts

    def find(self, query: Q.Query, session: str | None = None, agent: str | None = None, check: Callable[[], None] = lambda: None, done: Callable[[Found], None] = lambda _: None) -> Found:
        hits, texts = self._searched(query, session, agent)
        beyond = bool(texts.agg(F.max("beyond")).first()[0])
        cover = adaptive.coverage(self.audit.select("path", "reason", F.col("text").isNotNull().alias("indexed"))).first().asDict()
        check()
        return Found.of(hits, texts, cover, self.truncated or beyond or not cover["complete"], list(query.terms))


__all__ = ["Answers", "Cancelled", "Context", "DeadlineExceeded", "Engine", "Found"]
