from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash, vptree


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(keys, fps, radius):
    roots = plain_roots(fps, radius)
    known = {r: [k for k, q in zip(keys, roots, strict=True) if q == r and k is not None] for r in set(roots)}
    return [min(known[r]) if known[r] else None for r in roots]


def plain_roots(fps, radius):
    up = list(range(len(fps)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, mark string").repartition(3)
    return df, sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \n")],
        [(5, "A b c d"), (3, "a B\tc  d"), (9, "a b c"), (2, "a b"), (4, "a"), (7, "É b c"), (8, "é b c")],
        [(1, "x y z"), (1, "x y z"), (1, "q"), (None, "x y z"), (None, "only null")],
        [(1, "long text here " * 100_000), (2, "long text here " * 100_000 + "end")],
    ],
)
def test_near_duplicate_cases(spark, rows):
    df, got = near(spark, rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_groups([i for i, _ in rows], fps, 2)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True)), key=repr)
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and kept.count() == len(set(plain_roots(fps, 2)))
    assert {r.doc_id for r in kept.collect()} == set(comps)


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_and_components_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 1, 3, 7, 2**64 - 1, 2**63}
    for b in base:
        for _ in range(4):
            for _ in range(rng.randint(0, 3)):
                b ^= 1 << rng.randrange(64)
            fps.add(b)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long").repartition(4)
    labels = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(rows)).collect()}
    groups = plain_groups(list(range(len(fps))), fps, 2)
    mine = {}
    for f, g in zip(fps, groups, strict=True):
        mine.setdefault(g, set()).add(labels.get(f, f))
    assert all(len(v) == 1 for v in mine.values())
    assert len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and 5000 not in got
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            scored = sorted({(-(a * b).sum(), i) for i, b in good if i != q and len(b) == len(a)})
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("factor", [1.0, 1.1])
@pytest.mark.parametrize(("shard", "leaf"), [(40, 4), (8192, 128)])
def test_search_is_exact_at_factor_one(spark, monkeypatch, factor, shard, leaf):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "LEAF", leaf)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 5])).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 7, factor).collect()}
    want = brute(rows, 7)
    if factor == 1.0:
        assert got == want
    else:
        pairs = lambda x: {(q, i) for q, _, i, _ in x}
        assert len(pairs(got) & pairs(want)) >= 0.9 * len(want)


def test_search_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (100, []), (120, [1.0, None]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [2.0, 1.0]), (140, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 3, 1.0).collect()} == brute(rows, 3)
    many = [(i, [0.5, 0.5]) for i in range(3000)] + [(5000, [0.1, 0.2])]
    got = vptree.nearest(spark.createDataFrame(many, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") == 5000, 4, 1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vptree.nearest(df.where("vec_id = 7"), F.col("vec_id") % 20 == 0).count() == 0
