from __future__ import annotations

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dedup, runs, selection

LONG = "rec long, ctx_pos int, t_pos int, h string, r string, t string"


@pytest.fixture(scope="module")
def triples(spark):
    rng = random.Random(1)
    rows = [(rec, c, p, rng.choice(("A", "AB", "B", "C")), rng.choice("rs"), rng.choice(("A", "B", "C", "D"))) for rec in range(60) for c in range(3) for p in range(5)]
    return rows, spark.createDataFrame(rows, LONG).repartition(5)


def test_merge_equals_a_sequential_walk(triples):
    rows, df = triples
    expected = {}
    for rec, own in groupby(sorted(rows), key=lambda x: x[0]):
        seen, kept, tails = {"substring": 0, "duplicate": 0, "collision": 0}, [], {}
        for _, c, p, h, r, t in own:
            if t in h:
                seen["substring"] += 1
            elif (h, r) not in tails:
                tails[h, r] = t
                kept.append((c, p, h, r, t))
            else:
                seen["duplicate" if tails[h, r] == t else "collision"] += 1
        expected[rec] = (kept, seen)
    got = {}
    for x in dedup.merge_global(df).collect():
        got.setdefault(x.rec, []).append((x.ctx_pos, x.t_pos, x.h, x.r, x.t))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    for x in dedup.merge_counters(df).collect():
        assert (x.seen, x.kept, {k: x[k] for k in ("substring", "duplicate", "collision")}) == (15, len(expected[x.rec][0]), expected[x.rec][1])


def test_pairs_keep_their_first_triple(triples):
    rows, df = triples
    expected = set()
    for rec, own in groupby(sorted(rows), key=lambda x: x[0]):
        seen = set()
        for x in own:
            pair = frozenset((x[3], x[5]))
            if len(pair) == 2 and pair not in seen:
                seen.add(pair)
                expected.add(x)
    assert {tuple(x) for x in dedup.first_per_pair(df).select("rec", "ctx_pos", "t_pos", "h", "r", "t").collect()} == expected
    total = dedup.pair_counters(df).agg(*(F.sum(c) for c in ("raw", "self_loops", "duplicates", "pair_repeats", "kept"))).first()
    assert total[0] == len(rows) and sum(total[1:]) == len(rows) and total[4] == len(expected)


@pytest.mark.parametrize(("text", "segments", "largest", "back"), [("AAB", 2, 2, 0), ("ABA", 3, 1, 1), ("ABABB", 4, 2, 2), ("", 0, None, 0)])
def test_run_statistics(spark, text, segments, largest, back):
    df = spark.createDataFrame(list(enumerate(text)), "i long, v string")
    row = runs.run_stats(df, "i", "v").first()
    assert (row.segments, row.max_segment, row.non_contiguous) == (segments, largest, back)


def test_runs_cross_partitions_and_nulls(spark):
    rng = random.Random(4)
    values = [rng.choice(("a", "b", None)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(9)
    expected = [(k, len(list(g))) for k, g in groupby(values)]
    got = [(r.v, r["size"]) for r in runs.run_groups(df, "i", "v").orderBy("run").collect()]
    assert got == expected


def test_contiguity(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1)], "g long, s long")
    assert {r.g: r.contiguous for r in runs.contiguity(df, "g", "s").collect()} == {1: True, 2: False, 3: False}


def test_selection_is_by_hash_and_unique(spark):
    rows = [(0, "Who  is X?"), (1, "who is x?"), (2, "B"), (3, "C"), (4, " "), (5, None)]
    df = spark.createDataFrame(rows, "i long, q string")
    expected = {}
    for i, q in rows:
        key = " ".join(q.split()).lower() if q else ""
        if key:
            pri = hashlib.sha256(f"7\0{key}\0{i}".encode()).hexdigest()
            expected[key] = min(expected.get(key, ("z", 0)), (pri, i))
    order = sorted((p, i, k) for k, (p, i) in expected.items())
    got = selection.select_unique(df, "q", "i", 3, seed=7).orderBy("rank").collect()
    assert [(r.priority, r["index"], r.key) for r in got] == order
    with pytest.raises(ValueError, match="4 unique questions"):
        selection.select_unique(df, "q", "i", 4, seed=7)
    less = selection.select_unique(df, "q", "i", 2, seed=7, exclude=spark.createDataFrame([(order[0][2],)], "key string"))
    assert [r.key for r in less.orderBy("rank").collect()] == [k for *_, k in order[1:]]


def test_seeded_sample_replays_the_generator(spark):
    df = spark.range(50).withColumnRenamed("id", "i")
    drawn = random.Random(3).sample(range(50), 8)
    assert [r.i for r in selection.seeded_sample(df, "i", 50, 8, 3, keep_order=True).collect()] == drawn
    assert [r.i for r in selection.seeded_sample(df, "i", 50, 8, 3).collect()] == sorted(drawn)


def test_shards_and_first_contexts(spark):
    assert [tuple(r) for r in selection.shards(spark.range(7), "id", 3).orderBy("shard").collect()] == [(0, 0, 3), (1, 3, 3), (2, 6, 1)]
    ctxs = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (1, 3, "c")], "rec long, ctx_pos int, ctx_id string")
    assert sorted(r.ctx_id for r in selection.first_contexts(ctxs, 2).collect()) == ["a", "b"]


def test_questions_are_compared_by_marks(spark):
    """No text is moved: rows meet by the digests of their keys, and the keys of the chosen are made anew, of rows with one index too."""
    rows = [(i % 40, f"{'Straße' if i % 2 else 'STRASSE'}{' ' * (i % 3 + 1)}\t{i // 6} ") for i in range(90)] + [(99, " \n"), (98, None)]
    df = spark.createDataFrame(rows, "i long, q string")
    assert selection.ranked_unique(df, "q", "i", 7).columns == ["mark", "priority", "index"]
    best = {}
    for i, q in rows[:90]:
        key = " ".join(q.split()).casefold()
        best[key] = min(best.get(key, ("~",)), (hashlib.sha256(f"7\0{key}\0{i}".encode()).hexdigest(), i))
    want = [(k + 1, i, p, key) for k, (p, i, key) in enumerate(sorted((p, i, key) for key, (p, i) in best.items())[:12])]
    assert [(r["rank"], r["index"], r["priority"], r["key"]) for r in selection.select_unique(df, "q", "i", 12, seed=7).orderBy("rank").collect()] == want
