"""The structural graph of files: edges from references, imports and shared names, and centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import discard, stored

#: Edge weights by kind (fixed values).
WEIGHTS = {"implementation": 0.95, "call": 0.90, "type": 0.85, "reference": 0.80, "import": 0.40, "lexical": 0.15}
DAMPING, ITERATIONS = 0.85, 12


def weight(kind: Column) -> Column:
    out = F.when(kind == "implementation", WEIGHTS["implementation"])
    for k in ("call", "type", "import", "lexical"):
        out = out.when(kind == k, WEIGHTS[k])
    return out.otherwise(WEIGHTS["reference"])


def reference_edges(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """src, dst, kind, weight: refs (path, name, kind) to files that define the name, case aside. Each
    side is made distinct before the join, so a name used often in one file is one row."""
    r = refs.select(F.col("path").alias("src"), T.ascii_lower(F.col("name")).alias("name"), "kind").distinct()
    d = definitions.select(F.col("path").alias("dst"), T.ascii_lower(F.col("name")).alias("name")).distinct()
    return r.join(d.hint("merge"), "name").select("src", "dst", "kind", weight(F.col("kind")).alias("weight")).distinct()


def nearest_reference_edges(refs: DataFrame, definitions: DataFrame, limit: int = 6) -> DataFrame:
    """Those of reference_edges that can be among a file's `limit` heaviest links, by weight and then by path.

    A name that many files define gives each file that uses it as many edges, n * n in all. Edges through one
    name and kind are of one weight and ordered by path, so only the name's first limit + 1 files can matter (one more
    than the limit, as a file doesn't link to itself). They are found by a bounded aggregation, so the edges grow
    with the references."""
    r = refs.select(F.col("path").alias("src"), T.ascii_lower(F.col("name")).alias("name"), "kind").distinct()
    d = definitions.select(F.col("path").alias("dst"), T.ascii_lower(F.col("name")).alias("name")).distinct()
    first = least(d, "name", "dst", limit + 1).withColumnRenamed("value", "dst")
    return r.join(first.hint("merge"), "name").select("src", "dst", "kind", weight(F.col("kind")).alias("weight")).where("src <> dst").distinct()


def least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key, value: the n least values of each key. A hot key is cut down in parts first, so none is one task's."""
    for parts in (64, 1):
        own = Window.partitionBy(key, F.pmod(F.xxhash64(value), F.lit(parts))).orderBy(value)
        rows = rows.select(key, F.col(value), F.row_number().over(own).alias("_place")).where(F.col("_place") <= n).drop("_place")
    return rows.select(key, F.col(value).alias("value"))


def module_path(path: Column) -> Column:
    """The path without its extension and without /mod at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "(?:/mod)+$", "")


def stem(path: Column) -> Column:
    return F.regexp_extract(module_path(path), "([^/]*)$", 1)


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, kind, weight: an import ends with a file's stem or module path, or that ends with it.

    A suffix that ends with a stem has it as its tail, and stems have no "/": so candidates come from equi
    joins, by the tails of the import's last component for the stem (which the module path's tail implies),
    and by last component for the module path that ends with the import. Many files import one module, so a module
    is looked up once, and files then meet what their modules are. All sides grow with the files, and Spark expects
    far too little of a made column's size, so it is asked not to broadcast any.
    """
    own = imports.select(F.col("path").alias("src"), "module").distinct()
    i = own.select("module").distinct()
    f = files.select(F.col("path").alias("dst"), module_path(F.col("path")).alias("mp"), stem(F.col("path")).alias("stem")).distinct()
    last = F.regexp_extract("module", "([^/]*)$", 1)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(last), F.lit(1))), lambda k: F.substr(last, k, F.char_length(last)))
    ends = i.withColumn("tail", F.explode(tails)).join(f.hint("merge"), F.col("tail") == F.col("stem"))
    # The other way: a module path ends with the import; its own tails, cut at any character.
    paths = f.withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("mp"), F.lit(1))), lambda k: F.substr("mp", k, F.char_length("mp")))))
    inside = i.join(paths.hint("merge"), F.col("module") == F.col("tail"))
    both = ends.select("module", "dst").unionByName(inside.select("module", "dst")).distinct()
    both = own.join(both.hint("merge"), "module").select("src", "dst").distinct()
    return both.select("src", "dst", F.lit("import").alias("kind"), F.lit(WEIGHTS["import"]).alias("weight"))


#: Characters of a name by which it is looked up in texts.
START = 4
#: Names that a text is searched for at once.
NAMES_TOGETHER = 1000


def _starts(low: Column) -> Column:
    """What a name of four bytes or more may begin with in the text: runs of START characters, and shorter ones
    of as many bytes (which need characters beyond ASCII)."""
    return F.transform(
        F.array(F.split(low, "")),
        lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.filter(F.array(*(F.array_join(F.slice(c, i, k), "") for k in range(1, START + 1))), lambda g: F.octet_length(g) >= 4)))),
    )[0]


def lexical_edges(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """src, dst, kind, weight: the lower-cased text of src contains a name of four bytes or more that dst
    defines.

    A text that contains a name contains its first four characters, or all of fewer ones: candidates come from
    an equi join on these. Each text then meets its own candidates once, so no text is joined to all names."""
    d = definitions.select(F.col("path").alias("dst"), T.ascii_lower(F.col("name")).alias("name")).where(F.octet_length("name") >= 4).distinct()
    low = files.select(F.col("path").alias("src"), T.ascii_lower(F.col("text")).alias("low"))
    names = d.select("name", F.substring("name", 1, START).alias("start")).distinct()
    found = low.select("src", F.explode(_starts(F.col("low"))).alias("start")).distinct().join(names, "start")
    # Names are looked for in lists of about NAMES_TOGETHER, however many a text may hold.
    lists = found.groupBy("src").agg(F.ceil(F.count("*") / NAMES_TOGETHER).alias("lists"))
    parted = found.join(lists, "src").groupBy("src", F.pmod(F.xxhash64("name"), F.col("lists")).alias("part")).agg(F.collect_list("name").alias("names"))
    hit = low.join(parted.select("src", "names"), "src")
    hit = hit.select("src", F.explode(F.filter("names", lambda n: F.contains("low", n))).alias("name")).distinct().join(d, "name").where("src <> dst")
    return hit.select("src", "dst").distinct().select("src", "dst", F.lit("lexical").alias("kind"), F.lit(WEIGHTS["lexical"]).alias("weight"))


def best_edges(edges: DataFrame) -> DataFrame:
    """The heaviest edge of each ordered pair; loops and weights that aren't positive numbers go."""
    good = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")))
    return good.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.max_by("kind", "weight").alias("kind"))


#: Graphs of at most so many edges and nodes are ranked in one task, which holds them in a few megabytes.
ONE_TASK = 100_000


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """id, rank over nodes (id) and edges (src, dst, weight).

    A node passes on its weights as they are, and spreads what they lack to 1 evenly; weights of more than
    1 are scaled to 1. The edges' size is checked: a small graph is ranked in one task. In a larger one a
    round is one join on src and one aggregation on dst, with what nodes lack as edges to no node; ranks
    are stored between rounds, so that no plan holds more than one.
    """
    nodes, edges = nodes.select("id"), edges.select("src", "dst", "weight")
    n, m = nodes.count(), edges.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    if max(n, m) <= ONE_TASK:
        return _ranked_in_one_task(nodes, edges, iterations)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.greatest("out", F.lit(1.0))).alias("share"))
    lack = nodes.join(out, F.col("id") == F.col("src"), "left").select(F.col("id").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), (1 - F.least(F.coalesce("out", F.lit(0.0)), F.lit(1.0))).alias("share"))
    flow = stored(share.unionByName(lack.where("share > 0")), "pagerank-flow")
    rank, got = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(iterations):
        before, got = got, stored(rank.join(flow, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got")), "pagerank")
        if before is not None:
            discard(before)
        even = got.where("dst is null").agg(F.coalesce(F.sum("got"), F.lit(0.0))).first()[0]
        rank = nodes.join(got, F.col("id") == F.col("dst"), "left").select("id", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + even / n)).alias("rank"))
    return rank


def _ranked_in_one_task(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    import pandas as pd

    kind = nodes.schema["id"].dataType.simpleString()
    rows = nodes.select("id", F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("weight")).unionByName(edges.select(F.col("src").alias("id"), F.col("dst").cast(kind).alias("dst"), "weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["id"][pdf["weight"].isna()])
        at = {x: i for i, x in enumerate(ids)}
        e = pdf[pdf["weight"].notna()].sort_values(["id", "dst"])
        return pd.DataFrame({"id": ids, "rank": pagerank_small(len(ids), [(at[s], at[d], w) for s, d, w in zip(e["id"], e["dst"], e["weight"], strict=True)], iterations)})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"id {kind}, rank double")


def pagerank_small(n: int, edges: list[tuple[int, int, float]], iterations: int = ITERATIONS) -> list[float]:
    """The same for a map of a few files, on the driver."""
    out = [0.0] * n
    for s, _, w in edges:
        out[s] += w
    rank = [1.0 / n] * n
    for _ in range(iterations):
        even = sum(r * (1 - min(o, 1.0)) for r, o in zip(rank, out, strict=True)) / n
        got = [even] * n
        for s, d, w in edges:
            got[d] += rank[s] * w / max(out[s], 1.0)
        rank = [(1 - DAMPING) / n + DAMPING * g for g in got]
    return rank


def semantic_bonus(refs: DataFrame, terms: list[str]) -> DataFrame:
    """path, bonus: over references, the terms in the name times the kind's factor, at most 8."""
    kind = F.col("kind")
    factor = F.when(kind == "implementation", 1.0).when(kind == "call", 0.9).when(kind == "type", 0.85).otherwise(0.6)
    hits = T.count_contained(T.ascii_lower(F.col("name")), terms)
    return refs.groupBy("path").agg(F.least(F.sum(hits * factor), F.lit(8.0)).alias("bonus"))


def map_scores(hits: DataFrame, bonus: DataFrame, rank: DataFrame) -> DataFrame:
    """path, score: search score + 3 * bonus + 50 * centrality."""
    j = hits.join(bonus, "path", "left").join(rank.withColumnRenamed("id", "path"), "path", "left")
    return j.select("path", (F.col("score") + 3 * F.coalesce("bonus", F.lit(0.0)) + 50 * F.coalesce("rank", F.lit(0.0))).alias("score"))


def overridden(hits: DataFrame, maps: DataFrame, invalid: DataFrame) -> DataFrame:
    """hits with the map's score where the file is in the map; invalidated paths go."""
    m = maps.select("path", F.col("score").alias("_map"))
    j = hits.join(invalid.select("path"), "path", "left_anti").join(m, "path", "left")
    return j.withColumn("score", F.coalesce("_map", "score")).drop("_map")


class GraphCache:
    """Maps kept by their ordered (path, fingerprint) pairs, the least recently used going first."""

    def __init__(self, capacity: int = 64):
        self.capacity, self.held = capacity, {}

    def get(self, key: tuple) -> object | None:
        if key in self.held:
            self.held[key] = self.held.pop(key)
        return self.held.get(key)

    def put(self, key: tuple, value: object) -> None:
        self.held.pop(key, None)
        self.held[key] = value
        while len(self.held) > self.capacity:
            self.held.pop(next(iter(self.held)))


def links(edges: DataFrame, limit: int = 6) -> DataFrame:
    """Each file's heaviest links: src, dst, kind, weight, rank."""
    e = edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    return e.where(F.col("rank") <= limit)


def file_nodes(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "id string")
