"""Symbols, references and imports of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .policy import extension

#: Line starts that define a symbol and its kind, in the order in which they are tried (fixed values).
MARKERS = (
    ("pub async fn ", "function"), ("pub fn ", "function"), ("async fn ", "function"), ("fn ", "function"), ("def ", "function"), ("async def ", "function"),
    ("export async function ", "function"), ("export function ", "function"), ("function ", "function"), ("func ", "function"),
    ("pub struct ", "struct"), ("struct ", "struct"), ("pub enum ", "enum"), ("enum ", "enum"), ("pub trait ", "trait"), ("trait ", "trait"),
    ("interface ", "interface"), ("export interface ", "interface"), ("pub class ", "class"), ("export class ", "class"), ("class ", "class"),
    ("type ", "type"), ("pub type ", "type"), ("const ", "constant"), ("pub const ", "constant"), ("static ", "constant"), ("pub static ", "constant"), ("mod ", "module"), ("pub mod ", "module"),
)
#: No marker is the start of another, so at most one fits a line.
MARKER = r"^(" + "|".join(m for m, _ in MARKERS) + r")\s*([\p{IsAlphabetic}\p{N}_$-]+)"


def _ranked_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


def _limited(rows: DataFrame, order: list[str], limit: int | None, columns: list[str]) -> DataFrame:
    """rows' columns; with a limit, the first rows of each file, and truncated: whether it lost any."""
    if limit is None:
        return rows.select(columns)
    own = Window.partitionBy("path")
    ranked = rows.withColumns({"r": F.row_number().over(own.orderBy(*order)), "truncated": F.count("*").over(own) > limit})
    return ranked.where(F.col("r") <= limit).select(*columns, "truncated")


def heuristic_symbols(files: DataFrame, limit: int | None = None) -> DataFrame:
    """path, name, kind, line, signature: the first definition line of each name. With `limit`, as many a file,
    and truncated: whether it has more."""
    bare = F.regexp_replace("line", r"^\s+", "")
    rows = _ranked_lines(files).select("path", (F.col("pos") + 1).alias("line"), bare.alias("bare")).where(F.rlike("bare", F.lit(MARKER)))
    kinds = F.create_map(*(F.lit(x) for pair in MARKERS for x in pair))
    rows = rows.select("path", F.regexp_extract("bare", MARKER, 2).alias("name"), kinds[F.regexp_extract("bare", MARKER, 1)].alias("kind"), "line", F.substring("bare", 1, 220).alias("signature"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("path", "name").orderBy("line"))).where("r = 1")
    return _limited(first, ["line"], limit, ["path", "name", "kind", "line", "signature"])


def import_paths(files: DataFrame, limit: int | None = None) -> DataFrame:
    """path, module: each file's distinct imports in "/" form, by its language's line rules. With `limit`, as many
    a file, and truncated: whether it has more."""
    e, line = extension(F.col("path")), F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    take = lambda pattern: F.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1))
    rust = F.coalesce(take(r"^use (.*?)(?:::\{.*)?;*$"), take(r"^mod (.*?);*$"))
    python = F.coalesce(take(r"^from\s+(\S+)"), take(r"^import ([^,\s]*)"))
    script = F.when(F.startswith(line, F.lit("import ")) | F.contains(line, F.lit("require(")), T.quoted(line))
    go = F.when(F.rlike(line, F.lit('^(?:import |["`])')), F.when(T.quoted(line) != "", T.quoted(line)).otherwise(F.regexp_extract(line, "^`([^`]*)", 1)))
    found = F.when(e == "rs", F.trim(rust)).when(e.isin("py", "pyi"), python).when(e.isin("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), script).when(e == "go", go)
    module = F.replace(F.replace(F.regexp_replace(found, "^[\"'`]+|[\"'`]+$", ""), F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    rows = _ranked_lines(files).select("path", "pos", module.alias("module")).where("module <> ''")
    first = rows.groupBy("path", "module").agg(F.min("pos").alias("pos"))
    return _limited(first, ["pos"], limit, ["path", "module"])


# --- Syntax: the standard parser for Python, small lexers for the others. ---

_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_KEYWORDS = frozenset(
    "as async await break case catch class const continue crate default defer delete do dyn else enum export extends extern false finally fn for from func function go goto if impl implements import in "
    "instanceof interface let loop map match mod move mut new nil null package private protected public pub range ref return select self static struct super switch this throw trait true try type typeof undefined unsafe use var void where while yield".split()
)
_DEFINES = {
    "rust": re.compile(r"\b(fn|struct|enum|trait|type|const|static|mod|union|macro_rules!)\s+(?:mut\s+)?([A-Za-z_]\w*)"),
    "go": re.compile(r"\b(func|type|const|var)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    "script": re.compile(r"\b(function\*?|class|interface|enum|type|namespace)\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
}
_KIND = {"fn": "function", "func": "function", "function": "function", "function*": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "constant", "static": "constant", "var": "constant", "mod": "module", "namespace": "module", "macro_rules!": "macro", "class": "class", "interface": "interface"}
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "go": "go"} | dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"), "script")


def _blank(text: str) -> str:
    """The text with comments and strings blanked, line by line."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _python(text: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    symbols, refs, called, typed, bases = [], [], set(), set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            symbols.append((node.name, "function", node.lineno))
            typed |= {id(x) for a in (node.returns, *(p.annotation for p in (*node.args.args, *node.args.kwonlyargs))) if a for x in ast.walk(a)}
        elif isinstance(node, ast.ClassDef):
            symbols.append((node.name, "class", node.lineno))
            bases |= {id(x) for b in node.bases for x in ast.walk(b)}
        elif isinstance(node, ast.Call):
            called.add(id(node.func))
        elif isinstance(node, ast.AnnAssign):
            typed |= {id(x) for x in ast.walk(node.annotation)}
    for node in ast.walk(tree):
        name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None
        if name:
            kind = "implementation" if id(node) in bases else "call" if id(node) in called else "type" if id(node) in typed else "reference"
            refs.append((name, kind, node.lineno))
    return sorted(symbols, key=lambda s: s[2]), sorted(refs, key=lambda r: r[2])


def analyse(path: str, text: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """Symbols and references (name, kind, line) of a file in a known language, in source order."""
    lang = LANGUAGES.get(path.rpartition(".")[2].lower())
    if lang is None:
        return [], []
    if lang == "python" and (got := _python(text)):
        symbols, refs = got
    elif lang == "python":
        symbols, refs = [(m[2], _KIND.get(m[1], "function" if m[1] == "def" else "class"), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\b(def|class)\s+(\w+)", text)], []
    else:
        code = _blank(text)
        starts = [0, *(m.end() for m in re.finditer("\n", code))]
        line, symbols, refs, defined, k = 0, [], [], {}, 0
        for m in _DEFINES[lang].finditer(code):
            name, at = (m[2], m.start(2)) if m[2] else (m[3], m.start(3))
            defined[at] = name
            while k + 1 < len(starts) and starts[k + 1] <= at:
                k += 1
            symbols.append((name, _KIND.get(m[1] or "function", "function"), k + 1))
        for m in _WORD.finditer(code):
            while line + 1 < len(starts) and starts[line + 1] <= m.start():
                line += 1
            if m.start() in defined or m[0] in _KEYWORDS:
                continue
            before, after = code[starts[line] : m.start()].rstrip(), code[m.end() : m.end() + 3].lstrip()
            kind = "call" if after[:1] == "(" or after[:1] == "!" and lang == "rust" else "type" if before.endswith(("->", "as", "new")) or re.search(r"(?<!:):$", before) else "reference"
            if re.search(r"\b(impl|extends|implements)\b[^{;]*$", before):
                kind = "implementation"
            refs.append((m[0], kind, line + 1))
    names: dict[str, tuple[str, str, int]] = {}
    for s in symbols:
        names.setdefault(s[0], s)
    own = set(names)
    seen = dict.fromkeys(r for r in refs if len(r[0].encode()) >= 2 and not any(r[0] == n and r[2] == names[n][2] for n in own & {r[0]}))
    return list(names.values()), list(seen)


def syntax_facts(files: DataFrame, max_symbols: int | None = None, max_references: int | None = None) -> DataFrame:
    """path, fact ("symbol" or "reference"), name, kind, line of each file; null text has none. With limits, as
    many of a kind a file, and truncated: whether it has more of the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for fact, found, limit in zip(("symbol", "reference"), analyse(path or "", text or ""), (max_symbols, max_references), strict=True):
                    cut = limit is not None and len(found) > limit
                    rows += [(path, fact, *x, cut) for x in found[:limit]]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.string()] * 4, pa.int32(), pa.bool_()), strict=True)], ["path", "fact", "name", "kind", "line", "truncated"])

    facts = files.select("path", "text").mapInArrow(run, "path string, fact string, name string, kind string, line int, truncated boolean")
    return facts.drop("truncated") if max_symbols is max_references is None else facts


def combined_symbols(parsed: DataFrame, heuristic: DataFrame, limit: int | None = None) -> DataFrame:
    """Parsed symbols, then heuristic ones of other names: path, name, kind, line. With `limit`, as many a file,
    and truncated: whether it has more."""
    both = parsed.select("path", "name", "kind", "line", F.lit(0).alias("o")).unionByName(heuristic.select("path", "name", "kind", "line", F.lit(1).alias("o")))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("path", "name").orderBy("o", "line"))).where("r = 1")
    return _limited(first, ["o", "line"], limit, ["path", "name", "kind", "line"])


def with_signatures(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (path, line, ..) with signature: their own lines of files (path, text), trimmed and cut."""
    lines = files.select("path", T.lines(F.col("text")).alias("_lines"))
    return symbols.join(lines, "path").withColumn("signature", F.coalesce(T.signature(F.try_element_at("_lines", "line")), F.lit(""))).drop("_lines")


def symbol_score(name: Column, signature: Column, terms: list[str]) -> Column:
    """For each term: 6 if it is the name, else 4 if in the name, else 2 if in the signature."""
    low, sig = T.ascii_lower(name), T.ascii_lower(signature)
    out = F.lit(0)
    for t in terms:
        out = out + F.when(low == t, 6).when(F.contains(low, F.lit(t)), 4).when(F.contains(sig, F.lit(t)), 2).otherwise(0)
    return out


def ranked_symbols(symbols: DataFrame, terms: list[str], limit: int = 12) -> DataFrame:
    """Each file's best symbols for the query, with score and rank."""
    s = symbols.withColumn("score", symbol_score(F.col("name"), F.col("signature"), terms))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line", "name")))
    return s.where(F.col("rank") <= limit)
