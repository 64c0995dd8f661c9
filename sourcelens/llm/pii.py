"""Personal data, also in disguise, with spans in the source text.

The base detectors run on the text as it is. Then a transducer rewrites disguises into the characters they
stand for, keeping for each character it writes the source span it came from; the same detectors run on
its output, and what they find over a rewritten part is mapped back and added. Spans are in code points,
end exclusive. All matching is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int("0246813579"[int(d)]) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and domain: the longest run of local characters before each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while start > done:  # widening steps keep this linear in the run
            low = max(done, at - width)
            stops = [m.end() for m in _NOT_LOCAL.finditer(text, low, at)]
            start = low + (stops[-1] - low if stops else 0)
            if stops or low == done:
                break
            width *= 4
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[Span]:
    """Four numbers joined by dots, leftmost first along each chain of numbers."""
    for m in _CHAIN.finditer(text) if text.count(".") > 2 else ():
        if m[0].count(".") < 3:
            continue
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(x := p[0].lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                yield "ip", four[0].start(), four[3].end()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield "phone", *m.span()


def detect(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    found = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [*ips(text), *cards(text)]
        if "+" in text:
            found += phones(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = dict(zip("авсԁеһіјкӏмпорԛѕтухуАВСЕНІЈКМОРЅТХУαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abcdehijklmnopqstyxyABCEHIJKMOPSTXYaeiknoptuxABEZHIKMNOPTYX", strict=True))
#: Spelled digits in English, French, German and Spanish (fixed values).
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled "@" that is no common word, spelled "." and spelled "+" in the same languages (fixed values).
AT_SIGNS, DOTS, PLUSES = "arobase|arobas|arroba|klammeraffe|ät", "dot|point|punkt|punto", "plus|más|mas"
#: Last labels of addresses whose dots are spelled without brackets (fixed values).
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|eu|us|ch|at"
#: Characters that show nothing: soft hyphen, zero-width ones, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"


@cache
def look_of(c: str) -> str:
    """The ASCII character that a single character stands for, "" if it shows nothing, or itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain < "\x7f" and plain.isprintable():
        return plain
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


_STRANGE = re.compile(r"[^\x00-\x7f]")
#: White-space-free runs hold a look-alike only if they hold ASCII letters, digits or signs of an address too.
_RUN = re.compile(r"[^\s]+")
_AT_SIGNS = tuple(AT_SIGNS.split("|"))
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_NUMERAL = rf"(?:(?:{_WORD})(?![^\W\d_])|[0-9]++)"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:({PLUSES})[ -]+)?({_NUMERAL}(?:(?:[ -]+|[ ]+(?:{DOTS})[ ]+){_NUMERAL})+))(?![^\W\d_])")
_SPELLED_PART = re.compile(rf"(?i)({_WORD})(?![^\W\d_])|[ ]+({DOTS})[ ]+|([ -]+)")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Of a text in lower case.
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_WORD})[ -]+(?:(?:{DOTS})[ ]+)?{_NUMERAL}|(?<!\w)(?:{_WORD})[ ]+(?:{DOTS})[ ]|[ ](?:{DOTS})[ ](?:{_WORD}|[0-9])")
_BRACKETED = re.compile(rf"(?i)[ ]?[\[({{<][ ]?(?:(at|@|{AT_SIGNS})|({DOTS}|\.))[ ]?[\])}}>][ ]?")
#: "at" and "dot" are told from prose by what stands around them; the other words need another of their kind, or an "@".
_AT_SIGN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{{1,64}}(?:\.|[ ](?:{DOTS})[ ])){{0,6}}[A-Za-z0-9_%+-]{{1,64}}([ ](?:{AT_SIGNS})[ ])[A-Za-z0-9-]{{1,63}}(?:(?:\.|[ ](?:{DOTS})[ ])[A-Za-z0-9-]{{1,63}}){{1,5}}")
_POINTS_AFTER_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])@[A-Za-z0-9-]{{1,63}}(?:[ ](?:{DOTS})[ ][A-Za-z0-9-]{{1,63}}){{0,4}}[ ](?:{DOTS})[ ]([A-Za-z]{{2,63}})(?![A-Za-z0-9-])")
_AT_WORDS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{{1,64}}(?:\.|[ ]dot[ ])){{0,6}}[A-Za-z0-9_%+-]{{1,64}}([ ]at[ ])[A-Za-z0-9-]{{1,63}}(?:(?:\.|[ ]dot[ ])[A-Za-z0-9-]{{1,63}}){{0,4}}[ ]dot[ ](?:{ENDINGS})(?![A-Za-z0-9-])")
_DOT_WORD = re.compile(rf"(?i)[ ](?:{DOTS})[ ]")
_DOT_AFTER_AT = re.compile(rf"(?i)@[A-Za-z0-9-]{{1,63}}(?:(?:\.|[ ]dot[ ])[A-Za-z0-9-]{{1,63}}){{0,4}}[ ]dot[ ](?:{ENDINGS})(?![A-Za-z0-9-])")
_DOT_AFTER_LOCAL = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])@[A-Za-z0-9-]{{1,63}}(?:(?:\.|[ ]dot[ ])[A-Za-z0-9-]{{1,63}}){{0,4}}[ ]dot[ ]([A-Za-z]{{2,63}})(?![A-Za-z0-9-])")
_DOT_BEFORE_AT = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{{1,64}}(?:\.|[ ]dot[ ])){{1,6}}[A-Za-z0-9_%+-]{{1,64}}@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])")
#: Words before which "dot" is a noun (fixed values).
ARTICLES = frozenset("a an the this that these those each every any some no my your his her its our their one der die das le la les el un una".split())
#: " at " before a domain with plain or spelled dots, and what may be a local part before it.
_AT_DOMAIN = re.compile(rf"[ ][aA][tT][ ](?=((?:[A-Za-z0-9-]{{1,63}}(?:\.|[ ](?i:dot)[ ])){{1,5}})([A-Za-z]{{2,63}})(?![A-Za-z0-9-]))")
_LOCAL_BEFORE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{{1,64}}(?:\.|[ ](?i:dot)[ ])){{0,6}}[A-Za-z0-9_%+-]{{1,64}}\Z")
_STRUCTURED = re.compile(rf"[._%+]|[ ](?i:dot)[ ]|[A-Za-z][0-9]")
#: Words that say that an address follows (fixed values), and places where one may begin.
_CUE = re.compile(r"(?i)(?<![a-z])(?:e-?mails?|mail(?:to)?|contact|reach|write|ping|address|inbox|courriel|correo|kontakt|adresse)(?![a-z])[^\n.!?]{0,30}\Z")
_BEGINS = re.compile(r"(?:\A|[\n:;,(<\"'=|\[])[ \t]*\Z")
#: Words that stand before "at" or after "dot" in plain prose (fixed values).
COMMON = ARTICLES | frozenset(
    "i you he she it we they me him us them who what where when why how is are was were be been am do does did done go goes going gone went come comes came and or but nor so if as by in on to of for from with out off up down over "
    "about back here there now then today yet still only just also even again not all both more most much many less least few first last next best better early late online live open free new old look looks looked looking stare stared "
    "laugh laughed point pointed points aim aimed arrive arrived arrives meet meets met stay stayed stop stopped work works worked working live lives lived sit sat stand stood stands start started end ended held hosted host find found "
    "available visit visited see seen read more shop buy sold sell sale join joined try tried learn check call called people man men woman women time day night home page pages site website blog team code data file files product matrix".split()
)


class Tape:
    """A text being rewritten: its characters so far, and where each one lies in the source."""

    def __init__(self, text: str):
        self.text = text
        #: Pieces (start in text, end in text, start in source, end in source, rewritten), in order.
        self.pieces = [(0, len(text), 0, len(text), False)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the current text (in order, apart) by strings."""
        if not edits:
            return
        text, pieces, at, size = [], [], 0, 0
        starts = [p[0] for p in self.pieces]

        def keep(a: int, b: int) -> None:
            nonlocal size
            k = max(bisect_right(starts, a) - 1, 0)
            text.append(self.text[a:b])
            while a < b:
                t0, t1, s0, s1, changed = self.pieces[k]
                k += 1
                end = min(b, t1)
                if end <= a:
                    continue
                if changed:
                    pieces.append((size, size + end - a, s0, s1, True))
                else:
                    pieces.append((size, size + end - a, s0 + a - t0, s0 + end - t0, False))
                size += end - a
                a = end

        for a, b, new in edits:
            keep(at, a)
            if new:
                pieces.append((size, size + len(new), self.source(a, b)[0], self.source(a, b)[1], True))
                text.append(new)
                size += len(new)
            at = b
        keep(at, len(self.text))
        self.text, self.pieces = "".join(text), pieces

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of text[a:b], a < b."""
        starts = [p[0] for p in self.pieces] if len(self.pieces) < 64 else self._starts()
        t0, _, s0, _, changed = self.pieces[max(bisect_right(starts, a) - 1, 0)]
        u0, _, r0, r1, last = self.pieces[max(bisect_right(starts, b - 1) - 1, 0)]
        return s0 if changed else s0 + a - t0, r1 if last else r0 + b - u0

    def _starts(self) -> list[int]:
        if getattr(self, "_of", None) is not self.pieces:
            self._of, self._list = self.pieces, [p[0] for p in self.pieces]
        return self._list

    def rewritten(self) -> list[tuple[int, int]]:
        """Spans of the text that differ from the source, and places where something was taken out."""
        out = [(t0, t1) for t0, t1, *_, changed in self.pieces if changed]
        for x, y in zip(self.pieces, self.pieces[1:]):
            if x[3] < y[2]:
                out.append((x[1] - 1, x[1] + 1))
        return sorted(out)


def spelled_at(text: str, at: re.Match) -> int | None:
    """Where the address begins whose " at " is the given match of _AT_DOMAIN; None if it reads as prose.

    A domain with plain dots needs a cue before the local part, a local part that isn't one plain word, or one
    in lower case where a line or a phrase begins. One with a spelled dot needs just an uncommon local part.
    """
    low = max(0, at.start() - 400)
    m = _LOCAL_BEFORE.search(text[low : at.start()])
    labels, ending = re.split("[ .]+", at[1].lower()), at[2]
    if not m or not re.search("[A-Za-z]", m[0]) or not (ending.islower() or ending.isupper()) or not ARTICLES.isdisjoint(labels):
        return None
    before = text[max(0, low + m.start() - 60) : low + m.start()]
    if re.split("[^a-z]+", before.lower().rstrip(" "))[-1] in ARTICLES or m[0].lower() in COMMON:
        return None
    if " " in at[1]:
        sure = ending.lower() not in COMMON
    else:
        sure = _STRUCTURED.search(m[0]) or m[0].islower() and _BEGINS.search(before)
    return low + m.start() if sure or _CUE.search(before) else None


def normalise(text: str) -> Tape | None:
    """The text with disguises rewritten; None if it holds none."""
    tape = Tape(text)
    if not text.isascii():
        edits = []
        for m in _STRANGE.finditer(text):
            if (look := look_of(m[0])) != m[0]:
                edits.append((m.start(), m.end(), look))
        tape.rewrite(edits)
    now = tape.text
    if any(c in now for c in "[({<"):
        tape.rewrite([(*m.span(), "@" if m[1] else ".") for m in _BRACKETED.finditer(now)])
        now = tape.text
    low = now.lower()
    if any(w in low for w in _AT_SIGNS):
        edits = []
        for m in _AT_SIGN.finditer(now):
            edits += [(*m.span(1), "@"), *((*d.span(), ".") for d in _DOT_WORD.finditer(now, m.start(), m.end()))]
        tape.rewrite(sorted(edits))
        now = tape.text
    ats, dots = list(_AT_DOMAIN.finditer(now)), _DOT_WORD.search(now)
    if ats or dots:
        edits = {}
        for m in _AT_WORDS.finditer(now):
            edits[m.span(1)] = "@"
            edits |= {d.span(): "." for d in _DOT_WORD.finditer(now, m.start(), m.end())}
        for m in _DOT_AFTER_AT.finditer(now):
            edits |= {d.span(): "." for d in _DOT_WORD.finditer(now, m.start(), m.end())}
        for m in (*_DOT_AFTER_LOCAL.finditer(now), *_POINTS_AFTER_AT.finditer(now)):
            if m[1].lower() not in COMMON:
                edits |= {d.span(): "." for d in _DOT_WORD.finditer(now, m.start(), m.end())}
        for m in ats:
            if m.span() not in edits and (start := spelled_at(now, m)) is not None:
                edits[m.span()] = "@"
                edits |= {d.span(): "." for d in _DOT_WORD.finditer(now, start, m.end(2))}
        for m in _DOT_BEFORE_AT.finditer(now):
            if re.split("[ .]", m[0], maxsplit=1)[0].lower() not in ARTICLES:
                edits |= {d.span(): "." for d in _DOT_WORD.finditer(now, m.start(), m.end())}
        tape.rewrite([(*s, edits[s]) for s in sorted(edits)])
        now = tape.text
    low = now.lower()
    if (dots or not DIGITS.keys().isdisjoint(_LETTERS.findall(low))) and _SPELLED_HINT.search(low):
        edits = []
        for m in _SPELLED.finditer(now):
            if not re.search("[A-Za-z]", m[2]):
                continue
            if m[1]:
                edits.append((m.start(), m.start(2), "+"))
            for p in _SPELLED_PART.finditer(now, m.start(2), m.end(2)):
                edits.append((*p.span(), DIGITS[p[1].lower()] if p[1] else "." if p[2] else ""))
        tape.rewrite(edits)
    return tape if len(tape.pieces) > 1 or tape.pieces and tape.pieces[0][4] or tape.text != text else None


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans found in disguise, but for those that a base span of the same kind covers wholly."""
    tape = normalise(text)
    if tape is None:
        return []
    changed, out = tape.rewritten(), []
    ends = [b for _, b in changed]
    # Base spans of a kind lie apart, so of those the last one to begin at or before a span may cover it.
    own = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    starts = {k: [s for s, _ in own[k]] for k in KINDS}
    for kind, a, b in detect(tape.text):
        i = bisect_right(ends, a)
        if i < len(changed) and changed[i][0] < b:
            start, end = tape.source(a, b)
            at = bisect_right(starts[kind], start) - 1
            if at < 0 or own[kind][at][1] < end:
                out.append((kind, start, end))
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and those in disguise, by start and kind."""
    base = detect(text or "")
    more = disguised(text, base) if text else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def redact(text: str | None, found: list[Span] | None = None) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that overlap, one mark for all."""
    found = spans(text)[1] if found is None else found
    if not found:
        return text
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text; other columns are ignored): the numbers of base spans of each
    kind, base_sha256 of the joined base spans, and spans (all, joined). Null text counts as empty: no spans.
    Repeated rows repeat, and an empty table gives no rows. A text is held whole in one worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                counts, sha, said = [[] for _ in KINDS], [], []
                for text in part.column(1).to_pylist():
                    base, found = spans(text)
                    for c, x in zip(counts, KINDS, strict=True):
                        c.append(sum(s[0] == x for s in base))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    said.append(joined(found))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(said)], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with each personal-data span of `text` replaced; every row and column stays. Null and empty texts
    stay as they are, equal rows change alike, and an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                text = pa.array([redact(t) for t in part.column(at).to_pylist()], part.column(at).type)
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
