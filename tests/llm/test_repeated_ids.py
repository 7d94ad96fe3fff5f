from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vptree


def brute(rows, k):
    """The k best other ids of each query id, over all of its vectors and theirs."""
    best = {}
    for q, a in rows:
        for i, b in rows if q % 20 == 0 else ():
            if i != q:
                s = (np.array(a, np.float64) * np.array(b, np.float64)).sum()
                best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, -np.inf))
    return {(q, n, i, s) for q, found in best.items() for n, (s, i) in enumerate(sorted(((-s, i) for i, s in found.items()))[:k], 1) for s in [-s]}


def some(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(n)]


CASES = {
    "every row twice": some(120, 1) * 2,
    "copies of the query": some(60, 2) + [(20, [3.0, 1.0, 0.0, 0.0])] * 40 + [(i, [3.0, 1.0, 0.0, 0.0]) for i in range(200, 210)],
    "copies of another": some(60, 3) + [(7, [3.0, 1.0, 0.0, 0.0])] * 40 + [(i, [3.0, 1.0, 0.0, 0.0]) for i in range(200, 210)],
    "many vectors of an id": some(60, 4) + [(7, [5.0 + i / 8, 1.0, 0.0, 0.0]) for i in range(50)] + [(40, [4.0, i / 8, 0.0, 0.0]) for i in range(50)],
}


@pytest.mark.parametrize("shard", [30, 8192])
@pytest.mark.parametrize("name", list(CASES))
def test_answers_name_an_id_once(spark, monkeypatch, name, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "LEAF", 4)
    rows = CASES[name]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 7, 1.0).collect()}
    assert got == brute(rows, 7)
