"""A directory tree as two data sources: `repo_files` (metadata and exclusions) and `repo_sources` (texts).

Spark's own binary reader leaves out names that start with "." or "_", so trees are walked here. Links are
never followed. Ignore files count inside the root only. Directories are opened until there are enough parts to
read at once, and a large one is cut by names.
"""

from __future__ import annotations

import os
import re
import stat as st
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNull, StringStartsWith

from ..operators import policy as P

MAX_ENTRIES, MAX_PATH_BYTES, MAX_FILES = 100_000, 16 << 20, 50_000
IGNORE_FILES = (".gitignore", ".ignore")
#: Files whose directory is a project's root (fixed values).
ROOT_MARKS = (".git", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "setup.py")
STAMP = "length bigint, mtime_ns bigint, dev bigint, ino bigint, ctime_ns bigint, nlink bigint"
FILES = f"path string, reason string, {STAMP}"
SOURCES = f"path string, text string, reason string, {STAMP}"


@lru_cache(maxsize=4096)
def _glob(pattern: str) -> re.Pattern[str]:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out + r"\Z", re.S)


@dataclass(frozen=True)
class Ignore:
    """One ignore line, below the directory `base` ("" or ending in "/")."""

    base: str
    pattern: str
    negated: bool
    only_dirs: bool
    anchored: bool

    def fits(self, path: str, is_dir: bool) -> bool:
        if self.only_dirs and not is_dir or not path.startswith(self.base):
            return False
        rest = path[len(self.base) :]
        return bool(_glob(self.pattern).match(rest if self.anchored else rest.rpartition("/")[2]))


def ignore_lines(text: str, base: str) -> list[Ignore]:
    out = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:]
        only_dirs, body = body.endswith("/"), body.rstrip("/")
        anchored = "/" in body
        if body:
            out.append(Ignore(base, body.lstrip("/"), negated, only_dirs, anchored))
    return out


def ignored(rules: list[Ignore], path: str, is_dir: bool) -> bool:
    """The last line that fits decides."""
    return next((not r.negated for r in reversed(rules) if r.fits(path, is_dir)), False)


_BINARY, _PRUNED, _DENIED = frozenset(P.BINARY), frozenset(P.PRUNED_DIRS), frozenset(P.DENIED_PARTS)


def path_reason(path: str) -> str | None:
    """The policy of sourcelens.operators.policy for one path, while a tree is walked."""
    parts = [p for p in path.translate({c: c + 32 for c in range(65, 91)}).split("/") if p not in ("", ".")]
    name = parts[-1] if parts else ""
    env = (name == ".env" or name.startswith(".env.")) and name not in P.ENV_SAMPLES
    if not name or _DENIED & {*parts} or "/.config/gcloud/" in f"/{'/'.join(parts)}/" or name in P.DENIED_NAMES or name.endswith(tuple(P.DENIED_ENDS)) or ".tfstate." in name or env:
        return "denied"
    if _PRUNED & {*parts} or any(p.startswith("cmake-build-") for p in parts) or name in P.PRUNED_FILES:
        return "pruned"
    return "binary" if "." in name[1:] and name.rpartition(".")[2] in _BINARY else None


def _stamp(s: os.stat_result) -> tuple[int, ...]:
    return s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, s.st_ctime_ns, s.st_nlink


def own_rules(root: str, rel: str) -> list[Ignore]:
    """The ignore lines of one directory, rel ("" or ending in "/")."""
    out = []
    for name in IGNORE_FILES:
        try:
            with open(f"{root}/{rel}{name}", encoding="utf-8", errors="replace") as f:
                out += ignore_lines(f.read(), rel)
        except OSError:
            continue
    return out


def rules_above(root: str, rel: str) -> list[Ignore]:
    """What the repository excludes, and the ignore lines of the directories that hold rel, outermost first."""
    out = []
    exclude = f"{root}/.git/info/exclude"
    if os.path.isfile(exclude):
        with open(exclude, encoding="utf-8", errors="replace") as f:
            out = ignore_lines(f.read(), "")
    parts = rel.rstrip("/").split("/") if rel else []
    for k in range(len(parts)):
        out += own_rules(root, "".join(f"{p}/" for p in parts[:k]))
    return out


def _entries(root: str, rel: str, rules: list[Ignore], names: frozenset[str] | None = None) -> Iterator[tuple[str, bool, str | None, os.stat_result | None]]:
    """Path, whether it's a directory, reason and metadata of each entry of a directory that isn't ignored, by
    name. Raises OSError if the directory can't be listed."""
    for e in sorted(os.scandir(f"{root}/{rel}"), key=lambda e: e.name):
        if names is not None and e.name not in names:
            continue
        path = rel + e.name
        try:
            info = e.stat(follow_symlinks=False)
            path.encode()
        except (OSError, UnicodeEncodeError):
            yield path.encode("utf-8", "replace").decode(), False, "io", None
            continue
        is_dir = st.S_ISDIR(info.st_mode)
        if not ignored(rules, path, is_dir):
            yield path, is_dir, path_reason(path) or (None if is_dir or st.S_ISREG(info.st_mode) else "not_regular"), info


def walk(root: str, rel: str = "", deep: bool = True, names: frozenset[str] | None = None, above: list[Ignore] | None = None) -> Iterator[tuple]:
    """Rows of FILES below root/rel, or, not deep, of its own entries alone, or of those with the given names. An
    excluded directory is one row with a reason; a directory with a non-empty ignore file is one more (not
    where names are given, but for the first of a directory's parts)."""
    rules = rules_above(root, rel) if above is None else above
    own = own_rules(root, rel)
    if own and names is None:
        yield rel or ".", "ignore_file", *[None] * 6
    rules = [*rules, *own]
    try:
        for path, is_dir, why, info in _entries(root, rel, rules, names):
            if info is None:
                yield path, why, *[None] * 6
            elif is_dir and not why:
                if deep:
                    yield from walk(root, f"{path}/", above=rules)
            else:
                big = not is_dir and not why and (info.st_size > P.MAX_FILE_BYTES or info.st_nlink > 1)
                yield path, why or ("metadata" if big else None), *_stamp(info)
    except OSError:
        yield rel or ".", "io", *[None] * 6


def plan(root: str, want: int, chunk: int = 5000) -> list[tuple[str, bool, frozenset[str] | None]]:
    """The tree in parts (arguments of `walk`): directories are opened, outermost first, until there are `want`
    parts; an opened directory of more entries than `chunk` is several parts."""
    parts, queue = [], [("", rules_above(root, ""))]
    while queue and len(parts) + len(queue) < want:
        rel, above = queue.pop(0)
        rules = [*above, *own_rules(root, rel)]
        try:
            inside = list(_entries(root, rel, rules))
        except OSError:
            parts.append((rel, False, None))
            continue
        queue += [(f"{path}/", rules) for path, is_dir, why, _ in inside if is_dir and not why]
        own = [path[len(rel) :] for path, is_dir, why, _ in inside if not is_dir or why]
        if len(own) <= chunk:
            parts.append((rel, False, None))
        else:
            parts += [(rel, False, frozenset(own[k : k + chunk])) for k in range(0, len(own), chunk)]
            parts += [(rel, False, frozenset())] if rules[len(above) :] else []
    return [*parts, *((rel, True, None) for rel, _ in queue)]


def read_source(root: str, path: str) -> tuple[str | None, str | None, tuple[int, ...] | None]:
    """text, reason, stamp of a regular file, opened one component at a time without following links; the
    file must be the same before and after reading."""
    fds = [os.open(root, os.O_RDONLY | os.O_DIRECTORY)]
    try:
        *folders, name = path.split("/")
        for part in folders:
            fds.append(os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=fds[-1]))
        fds.append(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=fds[-1]))
        before = os.fstat(fds[-1])
        if not st.S_ISREG(before.st_mode):
            return None, "not_regular", None
        if before.st_nlink > 1:
            return None, "hard_linked", _stamp(before)
        data = b""
        while len(data) <= P.MAX_FILE_BYTES and (more := os.read(fds[-1], P.MAX_FILE_BYTES + 1 - len(data))):
            data += more
        after = os.fstat(fds[-1])
        if len(data) > P.MAX_FILE_BYTES:
            return None, "too_large", _stamp(before)
        if _stamp(before) != _stamp(after) or len(data) != before.st_size:
            return None, "changed", None
        return data.decode(), None, _stamp(before)
    except UnicodeDecodeError:
        return None, "non_utf8", _stamp(before)
    except FileNotFoundError:
        return None, "not_found", None
    except OSError:
        return None, "io", None
    finally:
        for fd in reversed(fds):
            os.close(fd)


class _Part(InputPartition):
    def __init__(self, rel: str, deep: bool, names: frozenset[str] | None):
        self.rel, self.deep, self.names = rel, deep, names


#: Parts that a tree is read in, at least, where it has as many directories.
PARTS = 32


class _Reader(DataSourceReader):
    """The root must be the same directory (device and inode) when it is listed and read as when it was loaded:
    this is checked before and after each partition's walk, where the walk runs.

    Filters on path (equal, among, beginning with) and on reason are pushed down: parts of the tree that can't
    hold such a path are not walked, and files that a filter leaves out are not opened."""

    def __init__(self, root: str, texts: bool, identity: str):
        self.root, self.texts, self.identity = root, texts, identity
        self.paths: set[str] | None = None
        self.starts: list[str] = []
        self.searchable: bool | None = None

    def guard(self) -> None:
        if identity(self.root) != self.identity:
            raise RuntimeError("the root was replaced since it was opened")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what narrows the walk; Spark applies all filters again but those on reason of texts' rows too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, EqualTo | In):
                these = {f.value} if isinstance(f, EqualTo) else {*f.value} - {None}
                self.paths = these if self.paths is None else self.paths & these
            elif getattr(f, "attribute", None) == ("path",) and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif getattr(f, "attribute", None) == ("reason",) and isinstance(f, IsNull):
                self.searchable = True
            yield f

    def wanted(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts)

    def may_hold(self, rel: str) -> bool:
        """Whether there may be wanted paths below a directory."""
        inside = self.paths is None or any(p.startswith(rel) or p == rel for p in self.paths)
        return inside and all(s.startswith(rel) or rel.startswith(s) for s in self.starts)

    def partitions(self) -> list[InputPartition]:
        self.guard()
        return [_Part(*p) for p in plan(self.root, PARTS) if self.may_hold(p[0])] or [_Part("", False, frozenset())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        self.guard()
        rows = walk(self.root, partition.rel, partition.deep, partition.names)
        if partition.names == frozenset():  # the directory's own ignore file is its one row
            rows = [(partition.rel or ".", "ignore_file", *[None] * 6)] if own_rules(self.root, partition.rel) else []
        for path, reason, *stamp in rows:
            if not self.wanted(path) or self.searchable and reason:
                continue
            if not self.texts:
                yield path, reason, *stamp
            elif reason:
                yield path, None, reason, *stamp
            else:
                text, why, now = read_source(self.root, path)
                yield path, text, why, *(now or stamp)
        self.guard()


class RepoFiles(DataSource):
    """spark.read.format("repo_files").load(root): a row for each file, or excluded entry with its reason."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], False, self.options["identity"])


class RepoSources(RepoFiles):
    """The same with each searchable file's text, verified while it is read."""

    @classmethod
    def name(cls) -> str:
        return "repo_sources"

    def schema(self) -> str:
        return SOURCES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], True, self.options["identity"])


def load(spark: SparkSession, root: str, texts: bool = True) -> DataFrame:
    """The tree at root, which must still be the same directory whenever it is read."""
    root = os.path.realpath(root)
    kind = RepoSources if texts else RepoFiles
    spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(kind.name()).option("identity", identity(root)).load(root)


def identity(root: str) -> str:
    found = os.stat(root)
    return f"{found.st_dev}:{found.st_ino}"


def load_capped(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """load, but at most MAX_FILES searchable files, and whether a discovery cap cut any."""
    good, cut = capped(load(spark, root, texts=False))
    sources = load(spark, root)
    if not cut:
        return sources, False
    # At most MAX_FILES paths.
    kept = sources.where("reason is null").join(F.broadcast(good.select("path")), "path", "left_semi")
    return kept.unionByName(sources.where("reason is not null")), True


def capped(files: DataFrame) -> tuple[DataFrame, bool]:
    """At most MAX_FILES searchable files by path, and whether that or another discovery cap cut any."""
    good = files.where("reason is null")
    n, entries, size = files.agg(F.count_if(F.col("reason").isNull()), F.count("*"), F.sum(F.octet_length("path"))).first()
    cut = n > MAX_FILES or entries > MAX_ENTRIES or (size or 0) > MAX_PATH_BYTES
    return (good.orderBy("path").limit(MAX_FILES) if cut else good), cut


def project_root(start: str, home: str | None = None) -> str:
    """The nearest directory at or above start that holds a mark of a project. Refused: the home
    directory, what lies above it, and directories that others may write to."""
    home = os.path.realpath(home or os.path.expanduser("~"))
    here = os.path.realpath(start)
    while True:
        mode = os.stat(here).st_mode
        if is_broad(here, home) or mode & (st.S_IWGRP | st.S_IWOTH):
            raise ValueError(f"no project root at or above {start}")
        if any(os.path.lexists(f"{here}/{m}") for m in ROOT_MARKS):
            return here
        here = os.path.dirname(here)


def is_broad(path: str, home: str) -> bool:
    return path == "/" or home == path or home.startswith(path.rstrip("/") + "/")
