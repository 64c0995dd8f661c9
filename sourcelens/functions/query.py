"""The query itself: its terms, who asks, and what follows from them. On the driver, but for tier_of."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUERY_BYTES, MAX_ID_BYTES, MAX_TERMS = 512, 96, 8
#: Words that are no terms (fixed values).
STOPWORDS = frozenset("and are for from how in into is of the this to where with".split())
_ASCII = {ord(a): ord(b) for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True)}
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,95}")


class QueryError(ValueError):
    """kind: EmptyQuery, QueryTooLong, TooFewTerms, TooManyTerms, InvalidSessionId or InvalidAgentId."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


@dataclass(frozen=True)
class Query:
    raw: str
    terms: tuple[str, ...]


def ascii_lower(s: str) -> str:
    return s.translate(_ASCII)


def words(s: str) -> list[str]:
    return re.findall(r"[\w-]+", s)


def normalize(q: str) -> Query:
    """One to eight distinct terms of two bytes or more that are no stopwords."""
    if not (q := q.strip()):
        raise QueryError("EmptyQuery")
    if len(q.encode()) > MAX_QUERY_BYTES:
        raise QueryError("QueryTooLong")
    low = ascii_lower(q)
    terms = tuple(dict.fromkeys(w for w in words(low) if len(w.encode()) >= 2 and w not in STOPWORDS))
    if not terms:
        raise QueryError("TooFewTerms")
    if len(terms) > MAX_TERMS:
        raise QueryError("TooManyTerms")
    return Query(low, terms)


def coordination(session_id: str | None, agent_id: str | None) -> tuple[str | None, str | None]:
    for value, kind in ((session_id, "InvalidSessionId"), (agent_id, "InvalidAgentId")):
        if value is not None and not _ID.fullmatch(value.strip()):
            raise QueryError(kind)
    return session_id and session_id.strip(), agent_id and agent_id.strip()


def result_limits(n_terms: int) -> tuple[int, int]:
    """Hits returned, and files in the structural map."""
    return (8, 6) if n_terms <= 1 else (16, 12) if n_terms <= 4 else (24, 16)


def candidate_limit(k: int) -> int:
    return min(max(16 * k, 64), 512)


#: Output budgets by tier: estimated tokens and bytes (fixed values).
TIERS = ((1800, 8192), (3600, 16384), (5400, 24576), (7200, 32768))


#: The most confident tiers first: least confidence, most excerpts, structures and terms (fixed values).
TIER_BOUNDS = ((0.88, 3, 6, MAX_TERMS), (0.72, 8, 12, MAX_TERMS), (0.0, 16, 16, 6))


def tier(confidence: float, excerpts: int, structures: int, terms: int) -> int:
    """The place in TIERS of the smallest budget that suffices."""
    for i, (sure, most_excerpts, most_structures, most_terms) in enumerate(TIER_BOUNDS):
        if confidence >= sure and excerpts <= most_excerpts and structures <= most_structures and terms <= most_terms:
            return i
    return len(TIER_BOUNDS)


def tier_of(confidence: Column, excerpts: Column, structures: Column, terms: Column) -> Column:
    """tier over columns."""
    out = F.lit(len(TIER_BOUNDS))
    for i, (sure, most_excerpts, most_structures, most_terms) in reversed(list(enumerate(TIER_BOUNDS))):
        out = F.when((confidence >= sure) & (excerpts <= most_excerpts) & (structures <= most_structures) & (terms <= most_terms), i).otherwise(out)
    return out


def estimated_tokens(s: str) -> int:
    return -(-(len(s.encode()) + 2 * sum(c > "\x7f" for c in s)) // 3)


def prefix(s: str, n: int) -> str:
    """The longest prefix of at most n bytes that ends between characters."""
    return s.encode()[:n].decode(errors="ignore")


def status(hits: int, truncated: bool, excluded: int) -> str:
    if hits and not truncated:
        return ""
    if truncated:
        return "Search is incomplete; matches may be missing." if hits else "Search is incomplete and found no match yet."
    return "No match in the searchable set; some files are excluded by policy." if excluded else "No match."
