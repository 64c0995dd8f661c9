import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelens.llm import minhash as M
from sourcelens.llm import queries as Q
from tests.oracle import same


def shingles(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words)} - {()} if len(words) < 2 else {*zip(words, words[1:])}


def naive(rows, percent=80):
    """doc_id to (size, least linked id) by comparing all sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def ours(df, **more):
    got = M.near_duplicates(df, **more).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [7, 1024])
def test_against_all_pairs(spark, monkeypatch, block):
    """A large group of near copies around the threshold, chains, small sets, and unrelated texts."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08, 0.12])))) for i in range(260)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(300, 320):
        chain[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(chain)))
    rows += [(400 + i, " ".join(f"t{k}" for k in range(rng.randrange(12)))) for i in range(80)]
    rows += [(500 + i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(40)))) for i in range(60)]
    rng.shuffle(rows)
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == naive(rows)


def test_query_and_twin(spark, data):
    same(Q.op11_hyperminhash(spark, data), Q.oracle_sql()["op11_hyperminhash"], data)


def test_estimates():
    """Registers' agreement, less the chance agreement, estimates the similarity within the stated spread."""
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.8), (300, 0.5), (3000, 0.8), (100_000, 0.8), (100_000, 0.0)):
        off = []
        for _ in range(6):
            pool = rng.permutation(np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64)))
            both = int(len(pool) * share)
            a, b = np.sort(pool[: both + (len(pool) - both) // 2]), np.sort(np.r_[pool[:both], pool[both + (len(pool) - both) // 2 :]])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same_, filled = M.agreement(M.registers(a), M.registers(b))
            estimate, ok = M.may_link(same_, filled, np.array([len(a)]), np.array([len(b)]), 80)
            off.append(float(estimate[0]) - truth)
            assert ok[0] == (share == 0.8)
        assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.1
    # Of two disjoint sets, registers agree by chance as often as said.
    regs = [M.registers(np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))) for _ in range(200)]
    got = np.mean([M.agreement(regs[i], regs[i + 1])[0] / M.BUCKETS for i in range(0, 200, 2)])
    assert abs(got - M.chance(np.array([5000.0]), np.array([5000.0]))[0]) < 1e-4


def test_registers_and_bands():
    shingle = np.array([3, 1 << 55, (1 << 55) + 5, (1 << 64) - 1], np.uint64)
    regs = M.registers(shingle)
    assert np.flatnonzero(regs).tolist() == [0, 1, 511] and M.registers(shingle[:0]).sum() == 0
    assert regs[511] >> M.MANTISSA == 1 and regs[511] & 1023 == 1023 and regs[1] == 54 << M.MANTISSA
    dense = M.densified(np.stack([regs, np.zeros_like(regs)]))
    assert (dense[0] != 0).all() and set(dense[0]) == {*regs.tolist()} - {0} and not dense[1].any()
    keys = M.band_keys(np.stack([regs, regs, M.registers(shingle[:2])]))
    assert keys.shape == (3, M.BUCKETS // M.ROWS) and (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == keys.shape[1]


def test_cases(spark):
    long = "word " + " ".join(map(str, range(60_000)))
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One"), (8, "oNE"), (9, "one two"), (7, long), (6, long + " x"), (None, "a b c d e f"), (11, "A b c d e f"), (None, "alone here"), (None, None), (2, "a b a b a b"), (1, "b a b a b"), (12, "É b"), (13, "é b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "SID": F.lit(1), "band": F.lit(2), "kept": F.lit(3)})
    assert ours(df) == naive(rows)
    assert M.near_duplicates(df.where("doc_id > 99")).collect() == []
    assert M.near_duplicates(df.where("text is null")).count() == 2
