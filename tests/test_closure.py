from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import closure, containment, graph
from tests.test_graph import plain_split, random_graph

NAMES = ["", "a", "b", "ab", "ba", "abc", "abca", "xabcx", "Supplier 1", "Supplier 12", "Supplier 112", "é", "née", "aé", "plier", "r 1", "\U0001f600", "x\U0001f600y"]


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    short = [(k, rng.choice(NAMES)) for k in range(6) for _ in range(9)] + [(7, None)]
    long = [(k, rng.choice(NAMES)) for k in range(6) for _ in range(9)] + [(7, "abc")]
    a, b = (spark.createDataFrame(x, "k long, name string") for x in (short, long))
    got = sorted(map(tuple, containment.contained(a, b, ["k"]).collect()))
    assert got == sorted({(k, x, y) for k, x in short for j, y in long if k == j and x is not None and x in y and x != y})
    alike = sorted(map(tuple, containment.alike_names(a, b, ["k"]).collect()))
    assert alike == sorted({(k, x, y) for k, x in short for j, y in long if k == j and x is not None and (x in y or y in x)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reachability_compares_names_by_an_index(spark):
    """One component of 100,000 nodes and as many pairs: names meet by equality of names or of grams, no nested loop."""
    n = 100_000
    edges = spark.range(n - 1).select(F.lit(1).alias("rec"), F.concat(F.lit("node "), F.hex(F.xxhash64("id"))).alias("u"), F.concat(F.lit("node "), F.hex(F.xxhash64(F.col("id") + 1))).alias("v"))
    name = lambda k: F.concat(F.lit("node "), F.hex(F.xxhash64(F.col("id") + k)))
    goal = F.when(F.col("id") % 4 == 0, name(5)).when(F.col("id") % 4 == 1, F.substring(name(5), 8, 12)).when(F.col("id") % 4 == 2, F.concat(F.lit("<"), name(5), F.lit(">"))).otherwise(F.concat(F.lit("?"), name(5)[8:9]))
    pairs = spark.range(n - 6).select(F.lit(1).alias("rec"), name(0).alias("a"), F.when(F.col("id") % 8 == 7, F.concat(F.lit("absent "), F.col("id").cast("string"))).otherwise(goal).alias("b"))
    found = graph.reachable(pairs, graph.components(edges, ["rec"]), ["rec"])
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    wanted = pairs.where("b not like 'absent%' and (b like '%node%' or b not like '?%')").distinct().count()
    assert found.count() == wanted


@pytest.mark.parametrize("largest", [graph.LARGEST, 0])
def test_batches_of_graphs_are_labelled_alike(spark, monkeypatch, largest):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 50]), rng.choice([None, "x"]), f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    rows = [r for r in rows if largest or None not in r]
    edges = spark.createDataFrame(rows, "rec long, part string, u string, v string")
    up = {}
    for k, p, u, v in rows:
        a, b = up.setdefault((k, p, u), {u}), up.setdefault((k, p, v), {v})
        a |= b
        for x in a:
            up[k, p, x] = a
    want = {(k, p, x, min(s)) for (k, p, x), s in up.items()}
    assert {tuple(r) for r in graph.components(edges, ["rec", "part"], largest).collect()} == want


def closed(spark, graphs, drawn):
    rows = [(rec, i, *t, i in drawn[rec]) for rec, ts in graphs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "rec long, pos long, h string, r string, t string, sampled boolean").repartition(3)
    return {(r.rec, r.pos): r.part for r in closure.promotion_closure(df).collect()}


def test_closure_equals_the_sequential_rule(spark):
    rng = random.Random(9)
    graphs = {rec: random_graph(rng, rng.randint(1, 14)) for rec in range(150)}
    drawn = {rec: rng.sample(range(len(ts)), len(ts) // 4) for rec, ts in graphs.items()}
    want = {(rec, i): p for rec, ts in graphs.items() for i, p in enumerate(plain_split(ts, drawn[rec], [])[0])}
    assert closed(spark, graphs, drawn) == want
    assert closed(spark, {}, {}) == {}


def test_closure_of_one_giant_record(spark):
    """A private chain hides the triple that closes it, which two public ones leak, and 20,000 triples stand around it in the same record."""
    chain = [("c0!", "r", "c1!"), ("c1!", "r", "c2!"), ("c0!", "q", "c2!"), ("z9?", "q", "c2!"), ("z9?", "s", "c0!")]
    rows = [(1, i, h, r, t, i < 2) for i, (h, r, t) in enumerate(chain)]
    df = spark.createDataFrame(rows, "rec long, pos long, h string, r string, t string, sampled boolean")
    more = spark.range(20_000).select(F.lit(1).alias("rec"), (F.col("id") + 10).alias("pos"), F.concat(F.lit("h"), F.lpad(F.hex("id"), 6, "0")).alias("h"), F.lit("m").alias("r"), F.concat(F.lit("t"), F.lpad(F.hex(F.col("id") % 7000), 6, "0")).alias("t"), (F.col("id") % 10 == 0).alias("sampled"))
    got = closure.promotion_closure(df.unionByName(more))
    parts = {r.pos: r.part for r in got.where("pos < 10").collect()}
    assert parts == {0: "private", 1: "private", 2: "leaked", 3: "public", 4: "public"}
    assert got.where("pos >= 10").groupBy("part").count().orderBy("part").collect() == [("private", 2000), ("public", 18000)]


def test_records_that_a_task_holds_need_no_index_of_names(spark, monkeypatch):
    """Each record is closed in one task; the rounds of joins, which larger ones take, give the same, null ends and relations too."""
    rng = random.Random(11)
    name = lambda: rng.choice([None, "a", "b", "ab", "abc", "c", "d", "de", "Supplier 1", "Supplier 12", "plier"])
    rows = [(rec, i, name(), rng.choice([None, "r", "s"]), name(), rng.random() < 0.25) for rec in (None, 1, 2, 3, 4, 5) for i in range(14)]
    df = spark.createDataFrame(rows, "rec long, pos long, h string, r string, t string, sampled boolean").repartition(3)
    tell = lambda x: sorted(map(repr, x.select("rec", "pos", "h", "r", "t", "part").collect()))
    by_joins = tell(closure.promotion_closure(df, largest=0))
    assert len(by_joins) == len(rows) and all(f"part='{p}'" in repr(by_joins) for p in ("public", "private", "leaked"))
    monkeypatch.setattr(closure, "alike_names", None)
    assert tell(closure.promotion_closure(df)) == by_joins
