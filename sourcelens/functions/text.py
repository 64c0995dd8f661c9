"""Text functions as columns. Lengths and limits are in UTF-8 bytes, case is folded for ASCII only."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits, "_" and "-".
TOKEN = r"[\p{IsAlphabetic}\p{N}_-]+"
#: Line starts that mark a definition, and those that mark an import (fixed values).
DEFINITION_STARTS = ("fn ", "pub fn ", "def ", "class ", "struct ", "enum ", "trait ", "interface ", "func ", "type ", "function ", "export function ", "export class ", "impl ", "mod ", "const ", "static ")
IMPORT_STARTS = ("use ", "import ", "from ", "require(", "#include")
MIN_BYTES = 2


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def tokens(c: Column) -> Column:
    """Token runs of at least two bytes, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: F.octet_length(x) >= MIN_BYTES)


def fragments(identifier: Column) -> Column:
    """Lower-cased parts of an identifier: between "_" and "-", and at changes of case (HTTPServer: http,
    server). Parts of one byte are left out."""
    cut = F.split(identifier, r"[_-]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.transform(F.filter(cut, lambda x: F.octet_length(x) >= MIN_BYTES), ascii_lower)


def grams(c: Column, width: int) -> Column:
    """Distinct substrings of `width` characters."""
    last = F.char_length(c) - (width - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def ascii_grams(c: Column) -> Column:
    """Distinct two- and three-character grams of the runs of ASCII token characters, lower-cased."""
    runs = F.filter(F.regexp_extract_all(ascii_lower(c), F.lit("[a-z0-9_-]+"), F.lit(0)), lambda x: F.octet_length(x) >= MIN_BYTES)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3)))))


def scalars(c: Column) -> Column:
    """The distinct characters of tokens that hold any non-ASCII character, lower-cased as ASCII."""
    odd = F.filter(tokens(c), lambda t: F.octet_length(t) > F.char_length(t))
    return F.array_distinct(F.flatten(F.transform(odd, lambda t: F.split(ascii_lower(t), ""))))


def query_grams(term: str) -> list[str]:
    """What a document's sketch must hold for it to contain the term: the pair or triples of an ASCII
    term, the characters of another one."""
    if not term.isascii():
        return sorted(set(term))
    width = min(3, len(term))
    return sorted({term[i : i + width] for i in range(len(term) - width + 1)})


def lines(c: Column) -> Column:
    """Lines without their ends (\\n or \\r\\n); an ending newline makes no empty last line."""
    parts = F.split(c, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_match(c: Column, terms: list[str]) -> Column:
    """The character place (from 1) of the first occurrence of any term in the lower-cased text; null: none."""
    low = ascii_lower(c)
    return F.array_min(F.filter(F.array(*(F.locate(t, low) for t in terms)), lambda p: p > 0))


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def count_contained(c: Column, terms: list[str]) -> Column:
    """How many of the terms the (lower-cased) text contains."""
    out = F.lit(0)
    for t in terms:
        out = out + F.when(F.contains(c, F.lit(t)), 1).otherwise(0)
    return out


def structural_bonus(line: Column, terms: list[str]) -> Column:
    """5 for a definition line that holds a term, 2 for an import line that does, else 0."""
    return structural_bonus_lower(ascii_lower(line), terms)


def structural_bonus_lower(low: Column, terms: list[str]) -> Column:
    """structural_bonus of a line in lower case. The starts are one anchored pattern each."""
    starts = lambda names: F.rlike(low, F.lit("^ *(?:" + "|".join(re.escape(n) for n in names) + ")"))
    return F.when(~contains_any(low, terms), 0.0).when(starts(DEFINITION_STARTS), 5.0).when(starts(IMPORT_STARTS), 2.0).otherwise(0.0)


def estimated_tokens(c: Column) -> Column:
    """A third of the bytes, with two more for each non-ASCII character, rounded up."""
    wide = F.char_length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return F.ceil((F.octet_length(c) + 2 * wide) / 3).cast("bigint")


def compact(c: Column) -> Column:
    """Right-trimmed lines, with only the first of each run of blank ones, each ended by a newline."""
    trimmed = F.transform(lines(c), lambda x: F.regexp_replace(x, r"\s+$", ""))
    pairs = F.arrays_zip(trimmed.alias("a"), F.concat(F.array(F.lit("x")), trimmed).alias("b"))
    kept = F.filter(pairs, lambda p: p["a"].isNotNull() & ((p["a"] != "") | (p["b"] != "")))
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.array_join(F.transform(kept, lambda p: p["a"]), "\n"), F.lit("\n")))


def signature(line: Column) -> Column:
    return F.substring(F.ltrim(line), 1, 220)


def quoted(line: Column) -> Column:
    """What stands between the first quote of either kind and its next twin; "" for none."""
    return F.regexp_extract(line, r"""^[^'"]*(['"])(.*?)\1""", 2)
