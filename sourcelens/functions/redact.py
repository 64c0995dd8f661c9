"""Redaction of high-confidence secrets.

Rules that a regular expression states are column expressions, usable alone. The rules that carry state
from line to line, or that track quotes, run in Python over a document's lines, through one Arrow UDF.
Line counts are kept, so line numbers stay valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys whose literal values are secret (fixed values).
KEYS = (
    "password passwd secret token api_key apikey private_key credential credentials secret_access_key awssecretaccesskey clientsecret "
    "accesstoken refreshtoken authtoken dbpassword databasepassword connection_string connectionstring database_url databaseurl "
    "authorization proxy_authorization proxyauthorization cookie set_cookie setcookie session_id sessionid session_token sessiontoken"
).split()
#: Prefixes of provider tokens and the least length of a whole token (fixed values).
PROVIDERS = {"github_pat_": 32, "ghp_": 32, "glpat-": 24, "npm_": 24, "pypi-": 24, "xapp-": 32, "xoxb-": 32, "xoxp-": 32, "AIza": 30, "AKIA": 20, "ASIA": 20, "sk-": 24}
MAX_LINE = 64 * 1024

_CRED = r"[A-Za-z0-9\-_.~+/=]"
URL = r"""((?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,31}://)(?=[^\s/?#'"<>]{3,}@)[^\s/?#'"<>]*:[^\s/?#'"<>]*@"""
HEADER = rf"(?i)(?<![A-Za-z0-9_])((?:proxy-)?authorization:\s*(?:bearer|basic)(?![A-Za-z])\s*){_CRED}+"
SCHEME = rf"(?i)(?<![A-Za-z0-9_])(?:(bearer\s+){_CRED}{{16,}}|(basic\s+){_CRED}{{12,}})"
JWT = r"(?<![A-Za-z0-9._-])(?=[A-Za-z0-9._-]{32,})eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?(?![A-Za-z0-9._-])"
TOKEN = "|".join(f"{p}[A-Za-z0-9_-]{{{n - len(p)},}}" for p, n in PROVIDERS.items())
#: Rules in the order in which they apply: name, pattern, replacement with \1 and \2 for groups kept.
RULES = (("url", URL, r"\1[REDACTED_URL_CREDENTIAL]@"), ("header", HEADER, r"\1[REDACTED_CREDENTIAL]"), ("scheme", SCHEME, r"\1\2[REDACTED_CREDENTIAL]"), ("jwt", JWT, "[REDACTED_JWT]"), ("token", TOKEN, "[REDACTED_TOKEN]"))
_COMPILED = {name: (re.compile(p, re.A), r) for name, p, r in RULES}


def by_rule(c: Column, *names: str) -> Column:
    """The text with the named rules applied, JVM-side."""
    for name, pattern, new in RULES:
        if name in names:
            c = F.regexp_replace(c, pattern, new.replace("\\", "$"))
    return c


def by_form(c: Column, key: str, value: str) -> Column:
    """The text with each literal written `key = "value"` replaced, JVM-side: `value` is a pattern, and case counts.
    Other forms, keys and secrets stay; `redact_udf` has all rules."""
    return F.regexp_replace(c, f'({key} = "){value}"', '$1[REDACTED_LITERAL]"')


_COOKIE = re.compile(r"(?i)(?<![A-Za-z0-9])(?:set-)?cookie:[ \t]*(?=[^ \t])")
_KEY = re.compile(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(sorted(KEYS, key=len, reverse=True)) + r")(?![A-Za-z0-9_])")
_SEPARATED = re.compile(r"(['\"]?)\s*([:=])")
_MARK = "[REDACTED_"
_MARKED, _BLANK = re.compile(r"\[REDACTED_[^\]]*\]?"), re.compile(r"\s*")
_BLOCK = re.compile(r"[|>][+\-1-9]*,*")
_COMPUTED = re.compile(r"\$\{|[()]|=>|::|&&|\|\|")
_BLANKS = " \t"


def _closing(line: str, at: int, quote: str) -> int:
    """The place of the next unescaped quote from `at` on; -1 for none."""
    while at < len(line) and line[at] != quote:
        at += 2 if line[at] == "\\" else 1
    return at if at < len(line) else -1


def redact_cookies(line: str) -> str:
    """Each cookie header's value, up to the quote it stands in or else the end of the line."""
    out, at, quote, i = [], 0, "", 0  # quote: the one that place i stands in
    while m := _COOKIE.search(line, at):
        while i < m.start():
            if line[i] == "\\":
                i += 1
            elif line[i] in "'\"" and quote in ("", line[i]):
                quote = "" if quote else line[i]
            i += 1
        end = _closing(line, m.end(), quote) if quote else -1
        end = len(line) if end < 0 else end
        out += [line[at : m.end()], "[REDACTED_COOKIE]"]
        at = end
        if at >= len(line):
            break
    return "".join([*out, line[at:]])


def _literal(line: str, at: int) -> tuple[int, int] | None:
    """The span of a secret literal that starts after blanks at `at`, if there is one."""
    while at < len(line) and line[at].isspace():
        at += 1
    if at == len(line):
        return None
    if (quote := line[at]) in "'\"":
        end = _closing(line, at + 1, quote)
        value = line[at + 1 : end]
        if end < 0 or not value or _MARK in value and f"{_MARK}URL_CREDENTIAL" not in value:
            return None
        return at + 1, end
    end = re.compile(r"[^\s,}\];]*").match(line, at).end()
    value = line[at:end]
    if value.lower() in ("bearer", "basic") and line.startswith((_MARK, "{", "$", "<"), _BLANK.match(line, end).end()):
        return None
    if f"{_MARK}URL_CREDENTIAL" in value:
        return at, re.compile(r"[^\s,};]*").match(line, end).end()
    if not value or _MARK in value or value.lower() in ("true", "false", "null", "none") or value[0] == "$" or _COMPUTED.search(value):
        return None
    return at, end


def _assigned(line: str, end: int) -> tuple[int, int] | None:
    """The literal assigned to a key that ends at `end`: after "=" within 64 characters, or ":" within 32."""
    colon, equals = line.find(":", end, end + 33), line.find("=", end, end + 65)
    if equals >= 0 and (colon < 0 or equals < colon):
        return _literal(line, equals + 1)
    if colon >= 0 and (span := _literal(line, colon + 1)):
        if 0 <= span[1] <= equals and not re.search(r"[,}\];]", line[span[1] : equals]):
            return _literal(line, equals + 1)  # what stood there was a type
        return span
    return _literal(line, equals + 1) if equals >= 0 else None


def redact_literals(line: str) -> str:
    """Literals assigned to sensitive keys."""
    out, at, closed = [], 0, 0
    marks, mark = _MARKED.finditer(line), None
    ahead = next(marks, None)
    for m in _KEY.finditer(line):
        while ahead and ahead.start() + len(_MARK) <= m.start():  # the last mark that ends before the key
            mark, ahead = ahead, next(marks, None)
            closed = mark.end() if mark[0].endswith("]") else 0
        if m.start() < at or closed > m.start():
            continue
        if (span := _assigned(line, m.end())) and span[0] >= at:
            out += [line[at : span[0]], "[REDACTED_LITERAL]"]
            at = span[1]
    return "".join([*out, line[at:]]) if out else line


def redact_line(line: str) -> str:
    """All rules that need one line only."""
    for name in ("url", None, "header", "scheme", "jwt", "token"):
        line = _COMPILED[name][0].sub(_COMPILED[name][1], line) if name else redact_cookies(line)
    return redact_literals(line)


def _keys_with_tail(line: str) -> Iterator[tuple[re.Match, re.Match, bool]]:
    """Sensitive keys followed by a separator: the key, the separator, and whether the key is quoted."""
    bare = line.lstrip(_BLANKS)
    if bare.startswith(("#", "//")):
        return
    for m in _KEY.finditer(line):
        quoted = 0 < m.start() and m.end() < len(line) and line[m.start() - 1] in "'\"" and line[m.end()] == line[m.start() - 1]
        tail = _SEPARATED.match(line, m.end())
        if tail and bool(tail[1]) == quoted:
            yield m, tail, quoted


@dataclass
class _Pending:
    indent: int
    same: bool


def _dangling(line: str) -> _Pending | None:
    """A sensitive key whose value must stand on a later line."""
    indent = len(line) - len(line.lstrip(_BLANKS))
    for m, tail, quoted in _keys_with_tail(line):
        after = line[tail.end() :].strip()
        if not after or after.startswith(("#", "//")):
            return _Pending(indent, quoted or m.start() > indent)
    return None


def _block_start(line: str) -> str | None:
    """The line with a sensitive key's block indicator replaced."""
    for _, tail, _ in _keys_with_tail(line):
        if tail[2] == ":" and (v := re.compile(r"\s*([^\s#]+)").match(line, tail.end())) and _BLOCK.fullmatch(v[1]):
            return f"{line[: v.start(1)]}[REDACTED_MULTILINE_LITERAL]{line[v.end(1) :]}"
    return None


def _scalar(line: str, bare: str) -> str | None:
    """The line with its scalar replaced; None if it holds a nested value or a reference."""
    lead, mark = line[: len(line) - len(bare)], "[REDACTED_MULTILINE_LITERAL]"
    if bare.startswith(("{", "[", "- ", "$")):
        return None
    if bare[0] in "'\"":
        end = _closing(bare, 1, bare[0])
        return f"{lead}{bare[0]}{mark}{bare[end:]}" if end > 1 else None
    value = re.split(r"\s#", bare, maxsplit=1)[0].rstrip()
    if re.search(r":\s", bare) or not value or _COMPUTED.search(value):
        return None
    return f"{lead}{mark}{bare[len(value) :]}"


def split_lines(text: str) -> list[str]:
    """Lines without their ends; an ending newline makes no empty last line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


#: A line in which none of these occurs, and that no line before it waits for, has nothing to redact.
_HINTS = [*KEYS, "-----begin", "://", "bearer", "basic", "eyj", *(p.lower() for p in PROVIDERS)]
_HINT = re.compile("(?i)" + "|".join(map(re.escape, _HINTS)))
#: Those that hold no other one, and the characters that (?i) takes for ASCII letters though lower() doesn't.
_LEAST = tuple(h for h in _HINTS if not any(x in h for x in _HINTS if x != h))
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def hinted(text: str) -> bool:
    """Whether _HINT is found: plain searches in lower case are some times faster than the pattern."""
    if not text.isascii() and _FOLDED.search(text):
        return _HINT.search(text) is not None
    low = text.lower()
    return any(h in low for h in _LEAST)


def redact(text: str, max_bytes: int | None = None) -> tuple[str, bool]:
    """The redacted text, and whether it was cut at max_bytes or had an oversize line suppressed."""
    out: list[str] = []
    size, truncated, in_key, pending, block = 0, False, False, None, None
    for source in split_lines(text):
        line = source
        if max_bytes is not None and len(source.encode()) > MAX_LINE:
            line, pending, block, truncated = "[REDACTED_OVERSIZE_LINE]", None, None, True
            size += len(line) + 1
            if size > max_bytes:
                break
            out.append(line)
            continue
        if not in_key and pending is None and block is None and not hinted(line):
            size += len(line.encode()) + 1 if max_bytes is not None else 0
            if max_bytes is not None and size > max_bytes:
                truncated = True
                break
            out.append(line)
            continue
        bare = line.lstrip(_BLANKS)
        indent = len(line) - len(bare)
        if block is not None:
            if not bare or indent > block:
                line = bare = ""
            else:
                block = None
        if block is None and pending and bare and not bare.startswith(("#", "//")):
            waits, pending = pending, None
            if "-----BEGIN " in bare.upper() and "PRIVATE KEY" in bare.upper() or indent <= waits.indent and not waits.same:
                pass
            elif _BLOCK.fullmatch(bare.split()[0]):
                line, block = f"{line[:indent]}[REDACTED_MULTILINE_LITERAL]", waits.indent
            else:
                line = _scalar(line, bare) or line
        if block is None and (started := _block_start(line)):
            line, block, pending = started, indent, None
        upper = line.upper()
        ends = "-----END " in upper and "PRIVATE KEY" in upper
        if "-----BEGIN " in upper and "PRIVATE KEY" in upper:
            line, in_key = "[REDACTED_PRIVATE_KEY]", not ends
        elif in_key:
            line, in_key = "", not ends
        else:
            line = redact_line(line)
        if pending is None and block is None:
            pending = _dangling(source)
        size += len(line.encode()) + 1
        if max_bytes is not None and size > max_bytes:
            truncated = True
            break
        out.append(line)
    return "\n".join(out) + ("\n" if out and text.endswith("\n") else ""), truncated


#: Texts that are Python objects at a time.
TOGETHER = 256


@F.arrow_udf(StringType())
def redact_udf(texts: pa.Array) -> pa.Array:
    """redact() of each text, batch by batch; nulls stay. Of a batch, TOGETHER texts are Python strings at a time,
    and a run of them in which nothing was found is passed on as it came."""
    out = []
    for k in range(0, len(texts), TOGETHER):
        part = texts.slice(k, TOGETHER)
        old = part.to_pylist()
        new = [t if t is None or not hinted(t) else redact(t)[0] for t in old]
        out.append(part.cast(pa.string()) if all(a is b for a, b in zip(old, new, strict=True)) else pa.array(new, pa.string()))
    return pa.concat_arrays(out) if out else texts
