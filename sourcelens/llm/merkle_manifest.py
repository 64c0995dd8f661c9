"""Merkle manifest of a dataset: a root over all rows, and for each row a proof, by fractal traversal.

Rows are leaves, in order within a group (a language); every ARITY consecutive nodes become one, level by
level, until a group has one node, its subroot; subroots, in order of their groups, become the root the same
way. Trees are cut into aligned blocks of ARITY ** HEIGHT leaves, each a bounded task. Blocks' roots are the
leaves of the next layer of blocks, so a layer is a table that is smaller by that factor, and a group of any
size is split over tasks.

Within a block the authentication paths come out leaf by leaf, as in fractal Merkle traversal: the block's
levels are split into bands of STRIDE levels, each with one existing subtree of ARITY ** STRIDE leaves, stacked
above the current leaf, and one desired subtree, that of its right neighbour, which grows by at most one leaf
of its own for each step and takes the existing one's place when the traversal enters it. So a path is read off
the stack, every node is hashed a bounded number of times, and only the stacked subtrees are held. Upper proofs
are made the same way over the blocks' roots and are appended to the paths of the block's leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running
from .common import discard, materialize

ARITY, HEIGHT, STRIDE = 8, 4, 2
BLOCK = ARITY**HEIGHT


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


class Subtree:
    """The nodes below node `place` of level `top` down to level `base` (0: the block's leaves), or what of them
    there is: the last run of a level may be shorter. It grows by its own leaves, from left to right."""

    def __init__(self, place: int, base: int, top: int, sizes: list[int]):
        self.base, self.top, self.sizes = base, top, sizes
        self.first = [place * ARITY ** (top - level) for level in range(base, top + 1)]
        self.rows: list[list[str]] = [[] for _ in self.first]
        self.want = min(sizes[base], self.first[0] + ARITY ** (top - base)) - self.first[0]

    @property
    def done(self) -> bool:
        return len(self.rows[0]) == self.want

    def grow(self, leaf: str) -> None:
        """Adds the next leaf of level `base`, and each node that is then complete."""
        self.rows[0].append(leaf)
        for k in range(1, len(self.rows)):
            below = self.rows[k - 1]
            if len(below) % ARITY and not len(self.rows[0]) == self.want:
                break
            done = len(self.rows[k]) * ARITY
            if done == len(below):
                break
            self.rows[k].append(digest("".join(below[done : done + ARITY])))

    def siblings(self, place: int, level: int) -> tuple[list[str], list[str]]:
        """The other nodes of the run that holds `place` of that level: those before, those after."""
        at, row = place - self.first[level - self.base], self.rows[level - self.base]
        start = at - at % ARITY
        return row[start:at], row[at + 1 : start + ARITY]


class Traversal:
    """Successive authentication paths of a block's leaves. height: levels above the leaves."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        self.sizes = [len(leaves)]
        for _ in range(height):
            self.sizes.append(-(-self.sizes[-1] // ARITY))
        self.bands = [(b, min(b + STRIDE, height)) for b in range(0, height, STRIDE)]
        self.hashed = 0
        self.existing: list[Subtree] = []
        self.desired: list[Subtree | None] = []
        self.pending: list[list[str]] = []
        # The first path needs the leftmost subtree of each band. The leaves of an upper one are the roots of the
        # subtrees of the band below, each of which is dropped once its root is known.
        for base, top in self.bands:
            tree = Subtree(0, base, top, self.sizes)
            for k in range(tree.want):
                tree.grow(self._node(k, base))
            self.existing.append(tree)
            self.desired.append(self._next(tree))

    def _node(self, place: int, level: int) -> str:
        """A node from the leaves: what a subtree of an upper band grows by."""
        if level == 0:
            return self.leaves[place]
        span = ARITY**level
        row = self.leaves[place * span : (place + 1) * span]
        for _ in range(level):
            row = [digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
        return row[0]

    def _next(self, tree: Subtree) -> Subtree | None:
        place = tree.first[-1] + 1
        return Subtree(place, tree.base, tree.top, self.sizes) if place < self.sizes[tree.top] else None

    @property
    def root(self) -> str:
        return self.existing[-1].rows[-1][0] if self.height else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[list[str], list[str]]]]:
        """For each leaf in order, its siblings (before, after) by level, from the leaves up."""
        for i in range(len(self.leaves)):
            for k, (base, top) in enumerate(self.bands):
                place = i // ARITY**top
                if place != self.existing[k].first[-1]:  # the traversal enters the desired subtree
                    self.existing[k] = self.desired[k]
                    self.desired[k] = self._next(self.existing[k])
                # One leaf of the desired subtree for each leaf of the existing one: it is whole when it's needed.
                if i % ARITY**base == 0 and (grown := self.desired[k]) is not None and not grown.done:
                    grown.grow(self._node(grown.first[0] + len(grown.rows[0]), base))
            yield [self.existing[k].siblings(i // ARITY**level, level) for k, (base, top) in enumerate(self.bands) for level in range(base, top)]


def levels_of(n: int) -> int:
    """How many levels a tree of n leaves has above them."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def _roots(rows: DataFrame) -> DataFrame:
    """g, block, size, digest: the root of each block of rows (g, place, size, digest). A group's last block goes
    as far up as the others if there are others, else to its one node."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, block, size = (k.as_py() for k in key)
        leaves = table.sort_by("place")["digest"].to_pylist()
        root = Traversal(leaves, min(HEIGHT, levels_of(size))).root
        return pa.table({"g": pa.array([g], pa.int64()), "place": pa.array([block], pa.int64()), "size": pa.array([-(-size // BLOCK)], pa.int64()), "digest": pa.array([root])})

    cut = rows.select("g", F.floor(F.col("place") / BLOCK).cast("bigint").alias("block"), "size", "place", "digest")
    return cut.groupBy("g", "block", "size").applyInArrow(run, "g bigint, place bigint, size bigint, digest string")


def _plain(path: list[tuple[list[str], list[str]]]) -> str:
    """A path as text: levels joined by ";", a level as its digests before the node, "|", those after it."""
    return ";".join(f"{''.join(a)}|{''.join(b)}" for a, b in path)


def fold(node: str, path: str) -> str:
    """The root that a node and its path lead to."""
    for level in path.split(";") if path else ():
        before, after = level.split("|")
        node = digest(before + node + after)
    return node


def siblings_of(path: str) -> str:
    return path.replace("|", "").replace(";", "")


def _with_paths(rows: DataFrame, upper: DataFrame, columns: list[str]) -> DataFrame:
    """rows (g, place, size, digest, columns) with `path`: that within the row's block, then the block's own
    from upper (g, place, path), where there is one."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        size = left["size"][0].as_py()
        rest = right["path"][0].as_py() if right.num_rows else ""
        paths = (_plain(p) for p in Traversal(left["digest"].to_pylist(), min(HEIGHT, levels_of(size))).paths())
        return left.drop_columns(["block"]).append_column("path", pa.array([";".join(filter(None, (p, rest))) for p in paths], pa.string()))

    cut = rows.select("g", F.floor(F.col("place") / BLOCK).cast("bigint").alias("block"), "place", "size", "digest", *columns)
    above = upper.select("g", F.col("place").alias("block"), "path")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("g", "place", "size", "digest", *columns)) + ", path string"
    return cut.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(run, schema)


def forest(leaves: DataFrame, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves (g, place from 0, size of the group, digest, columns; a stored table).

    Returns the roots (g, digest), and leaves with path: all siblings up to the root of the group. A layer of
    blocks' roots is a stored table; there are as many layers as the largest group has blocks of blocks."""
    layers = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        layers.append(materialize(_roots(layers[-1]), "manifest-layer"))
        largest = -(-largest // BLOCK)
    empty = leaves.select("g", "place", F.lit("").alias("path")).where(F.lit(False))
    upper = empty
    for layer in reversed(layers[1:-1]):
        upper = _with_paths(layer, upper, []).select("g", "place", "path")
    roots = reduce(lambda a, b: a.unionByName(b), [x.where("size = 1").select("g", "digest") for x in layers]).distinct()
    return roots, _with_paths(leaves, upper, list(columns))


def framed(columns: list[Column]) -> Column:
    """What a leaf's hash is over: for each column "-" if null, else its UTF-8 bytes' count, ":", and itself."""
    text = [c.cast("string") for c in columns]
    return F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text))


def build_manifest(rows: DataFrame, group: str, order: str, leaf: Column, other: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The manifest of rows: for each one carry, leaf, subroot, root, proof (its path as text: levels from the
    leaf up, each the siblings before the node, "|", those after, joined by ";"), proof_sha256 (of the siblings
    alone), and folded_root: what `other`, a digest that claims the row's place (default: the leaf), leads to.

    Groups are ordered by name (nulls first, else by UTF-8 bytes), rows in them by `order` (nulls first), ties
    by leaf; rows equal in both are alike and take neighbouring places. A null group is a group. Columns of any
    name may be carried. An empty table gives no rows. A group's rows are dealt into ranges and blocks, so a
    group that holds most rows is many tasks; the driver sees two counts.
    """
    own = [f"c{i}" for i in range(len(carry))]
    picked = rows.select(F.col(group).cast("string").alias("group"), F.col(order).alias("by"), leaf.alias("digest"), (leaf if other is None else other).alias("other"), *(F.col(c).alias(a) for c, a in zip(carry, own, strict=True)))
    hashed = materialize(picked, "manifest-leaves")
    counts = hashed.groupBy("group").agg(F.count("*").alias("size"))
    groups = running(counts, [], [F.col("group").asc_nulls_first()], "g")  # one row for each group
    groups = materialize(groups.select("group", F.col("g").cast("bigint"), F.col("size").cast("bigint")), "manifest-groups")
    # 60 bits of the leaf: ranges are sampled by these columns, so they're kept short.
    tie = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")
    placed = running(hashed, ["group"], [F.col("by").asc_nulls_first(), tie], "place").withColumn("place", (F.col("place") - 1).cast("bigint"))
    g = groups.withColumnRenamed("group", "named")
    placed = materialize(placed.join(g, F.col("group").eqNullSafe(F.col("named"))).select("g", "place", "size", "digest", "other", *own), "manifest-placed")
    discard(hashed)
    subroots, paths = forest(placed, ("other", *own))
    subroots = materialize(subroots, "manifest-subroots")
    n = groups.count()
    tops, top_paths = forest(materialize(subroots.select(F.lit(0).cast("bigint").alias("g"), (F.col("g") - 1).alias("place"), F.lit(n).cast("bigint").alias("size"), "digest", F.col("g").alias("of")), "manifest-tops"), ("of",))
    root = tops.select(F.col("digest").alias("root"))
    above = materialize(top_paths.select(F.col("of").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("top_path")).join(F.broadcast(root)), "manifest-above")  # root: one row
    both = F.concat_ws(";", F.when(F.col("path") != "", F.col("path")), F.when(F.col("top_path") != "", F.col("top_path")))
    whole = paths.join(above, "g").withColumn("proof", both)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proofs, others = b["proof"].to_pylist(), b["other"].to_pylist()
            yield pa.RecordBatch.from_arrays([*(b[c] for c in (*own, "digest", "subroot", "root", "proof")), pa.array([digest(siblings_of(p)) for p in proofs]), pa.array([fold(x, p) for x, p in zip(others, proofs, strict=True)])], [*own, "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root"])

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"{a} {kinds[a]}" for a in own) + (", " if own else "") + "leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string"
    done = whole.select(*own, "digest", "other", "subroot", "root", "proof").mapInArrow(folded, schema)
    return done.select(*(F.col(a).alias(c) for a, c in zip(own, carry, strict=True)), "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root")


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, checked against texts of which a part is tampered with.

    A leaf is over doc_id, source, lang, n_chars and text. Returns for each row doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified. Where 3 divides crc32 of the decimal id, the text that claims the
    row's place has A-Z in lower case; null texts, and those of null ids, stay."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    leaf = lambda text: F.sha2(framed([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]).cast("binary"), 256)
    made = build_manifest(docs, "lang", "doc_id", leaf(F.col("text")), leaf(lower), ("doc_id",))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc_table() -> list[int]:
    """The CRC-32 of each byte value, by its polynomial."""

    def entry(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    return [entry(c) for c in range(256)]


_CRC = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


def _levels(name: str, k: int) -> str:
    """CTEs name0.. (g, pos, d, n) of the levels above name0, and name_s0.. (g, pos, b, a), what stands before and
    after each node among its siblings."""
    out = []
    for i in range(k):
        frame = f"over (partition by g, pos // 8 order by pos rows between {{}})"
        b, a = (f"coalesce(string_agg(d, '') {frame.format(x)}, '')" for x in ("unbounded preceding and 1 preceding", "1 following and unbounded following"))
        out.append(f"{name}_s{i} as (select g, pos, case when n > 1 then {b} else '' end b, case when n > 1 then {a} else '' end a, n from {name}{i})")
        out.append(f"{name}{i + 1} as (select g, pos // 8 pos, case when n > 1 then sha256(string_agg(d, '' order by pos)) else any_value(d) end d, (n + 7) // 8 n from {name}{i} group by g, pos // 8, n)")
    return ", ".join(out)


def _climb(source: str, name: str, k: int) -> str:
    """CTEs that lead rows (g, pos, p, f) of source up the levels of name: p takes the siblings, f is folded."""
    out = []
    for i in range(k):
        out.append(f"{name}_c{i} as (select c.* replace (c.pos // 8 as pos, c.p || s.b || s.a as p, case when s.n > 1 then sha256(s.b || c.f || s.a) else c.f end as f) from {source} c join {name}_s{i} s on c.g = s.g and c.pos = s.pos)")
        source = f"{name}_c{i}"
    return ", ".join(out)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
_LEVELS, _TOPS = 7, 4
#: The same in DuckDB's SQL, for up to 8 ** 7 rows a language and 8 ** 4 languages.
SQL = f"""
with h as (select doc_id, lang, {_LEAF.format(t="text")} leaf, case when {_CRC} % 3 = 0 then {_LEAF.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_LEAF.format(t="text")} end other from documents),
x as (select *, dense_rank() over (order by lang nulls first) - 1 g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from h),
t0 as (select g, pos, leaf d, n from x), {_levels("t", _LEVELS)},
u0 as (select 0 g, g pos, d, count(*) over () n from t{_LEVELS}), {_levels("u", _TOPS)},
own as (select doc_id, leaf, g, pos, '' p, other f from x), {_climb("own", "t", _LEVELS)},
above as (select doc_id, leaf, g lang_g, 0 g, g pos, p, f from t_c{_LEVELS - 1}), {_climb("above", "u", _TOPS)}
select c.doc_id, c.leaf, s.d subroot, r.d root, sha256(c.p) proof_sha256, c.f folded_root, c.f = r.d verified from u_c{_TOPS - 1} c join t{_LEVELS} s on c.lang_g = s.g cross join u{_TOPS} r
"""
