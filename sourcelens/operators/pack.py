"""The output: excerpts and structure packed under byte and token budgets. At most 24 rows, on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..functions.query import estimated_tokens, prefix


@dataclass(frozen=True)
class Excerpt:
    path: str
    start: int
    end: int
    body: str
    score: float


def header(e: Excerpt) -> str:
    return f"{json.dumps(e.path, ensure_ascii=False)} lines {e.start}-{e.end} score {e.score:.3f}"


def render(excerpts: list[Excerpt], tokens: int, size: int) -> str:
    """Excerpts in order of score, path and line; one that passes either budget is left out. If the first
    one to be taken is too large itself, a marked prefix of it is all."""
    out, used = "", 0
    for e in sorted(excerpts, key=lambda e: (-e.score, e.path, e.start)):
        block = f"{header(e)}\n{e.body}\n"
        cost = estimated_tokens(block)
        if len((out + block).encode()) <= size and used + cost <= tokens:
            out, used = out + block, used + cost
        elif not out:
            mark = "\n[truncated]\n"
            room = min(size, tokens * 3) - len(mark)
            cut = prefix(block, max(room, 0))
            while cut and estimated_tokens(cut + mark) > tokens:
                cut = cut[: len(cut) * 9 // 10]
            return cut + mark
    return out


def structure(entries: list[tuple[str, float, list[str], list[tuple[str, str, float]]]], size: int) -> str:
    """Entries (path, score, symbols, links) until one doesn't fit."""
    out = "STRUCTURE\n"
    for path, score, symbols, links in entries[: 6 if size <= 2500 else 8 if size <= 4500 else 10]:
        block = f"{json.dumps(path, ensure_ascii=False)} {score:.3f}\n" + "".join(f"  {s}\n" for s in symbols[:4]) + "".join(f"  -> {p} ({k} {w:.2f})\n" for p, k, w in links[:5])
        if len((out + block).encode()) > size:
            break
        out += block
    return out
