import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sourcelens.llm import merkle_manifest as M
from sourcelens.llm import queries as Q
from tests.oracle import same


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def others(tree, i):
    out = ""
    for row in tree[:-1]:
        out += "".join(d for j, d in enumerate(row) if j // 8 == i // 8 and j != i)
        i //= 8
    return out


def naive(rows):
    """(id, lang, leaf) to {id: (leaf, subroot, root, proof hash)}, the whole trees in memory."""
    by = {}
    for i, lang, leaf in rows:
        by.setdefault(lang, []).append(((i is not None, i or 0), leaf, i))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf for _, leaf, _ in sorted(by[x], key=lambda r: r[:2])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    return sorted(
        (str(i), leaf, trees[x][-1][0], top[-1][0], sha(others(trees[x], k) + others(top, langs.index(x))))
        for x in langs
        for k, (_, leaf, i) in enumerate(sorted(by[x], key=lambda r: r[:2]))
    )


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513, 4095, 4096])
def test_traversal_is_the_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree, walk = levels(leaves), M.Traversal(leaves, M.levels_of(n))
    assert walk.root == tree[-1][0]
    for i, path in enumerate(walk.paths()):
        assert M.siblings_of(M._plain(path)) == others(tree, i)
        assert M.fold(leaves[i], M._plain(path)) == walk.root
        held = [x for x in (*walk.existing, *walk.desired) if x]
        assert sum(len(r) for x in held for r in x.rows) <= 2 * len(walk.bands) * (M.ARITY**M.STRIDE + M.ARITY + 1)


@pytest.mark.parametrize("height", [1, 4])
def test_against_whole_trees(spark, monkeypatch, height):
    """Blocks of eight leaves give several layers."""
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "BLOCK", M.ARITY**height)
    rows = [(i, "hot", sha(f"a{i}")) for i in range(700)] + [(i, f"l{i % 9}", sha(f"b{i}")) for i in range(1000, 1100)] + [(5000, None, sha("c")), (None, "hot", sha("d")), (7, "hot", sha("e")), (7, "hot", sha("e")), (6, "é", sha("f")), (6, "", sha("g"))]
    df = spark.createDataFrame(rows, "id int, lang string, d string").withColumns({"leaf": F.lit("x"), "G": F.lit(1), "path": F.lit(2), "proof": F.lit(3)})
    made = M.build_manifest(df.repartition(7), "lang", "id", F.col("d"), F.when(F.col("id") % 2 == 0, F.sha2("d", 256)).otherwise(F.col("d")), ("id",))
    got = made.collect()
    assert sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == naive(rows)
    assert all((r["folded_root"] == r["root"]) == (r["id"] is None or r["id"] % 2 == 1) for r in got)
    assert all(M.fold(r["leaf"], r["proof"]) == r["root"] for r in got)


def test_query_and_twin(spark, data):
    got = Q.op13_merkle_manifest(spark, data)
    same(got, Q.oracle_sql()["op13_merkle_manifest"], data)
    rows = got.collect()
    changed = [r for r in rows if not r["verified"]]
    assert 0 < len(changed) and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in changed)


def test_nulls_one_row_and_empty(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    one = spark.createDataFrame([(None, None, None, None, None)], schema)
    (r,) = M.document_manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == sha("-----") and r["proof_sha256"] == sha("") and r["verified"]
    assert M.document_manifest(one.where("doc_id = 1")).collect() == []
    long = spark.createDataFrame([(1, "é" * 300_000, "x", "", 3)], schema)
    (r,) = M.document_manifest(long).collect()
    assert r["leaf"] == sha("1:10:1:x1:3600000:" + "é" * 300_000)
