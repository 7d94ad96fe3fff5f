from __future__ import annotations

import random

import pytest

from graphloom.operators import evalsets, graph
from graphloom.plans import bridge, catalogue


def open_plainly(local, private, whole):
    """By building each document's graphs."""

    def reached(edges, a, b):
        seen, more = {a}, [a]
        while more:
            x = more.pop()
            for h, t in edges:
                for y, z in ((h, t), (t, h)):
                    if y == x and z not in seen:
                        seen.add(z)
                        more.append(z)
        return any(n in b or b in n for n in seen)

    out = set()
    for rec in {x[0] for x in private}:
        hidden = {(h, t) for k, h, _, t in private if k == rec}
        shown = {(h, t) for k, h, _, t in whole if k == rec} - hidden
        for ctx in {c for k, c, *_ in local if k == rec}:
            mine = {(h, t) for k, c, h, r, t in local if (k, c) == (rec, ctx) and (rec, h, r, t) in private}
            own = {(h, t) for k, c, h, _, t in local if (k, c) == (rec, ctx)} - mine
            out |= {(rec, ctx, h, t) for h, t in mine if reached(shown - own, h, t) and not reached(hidden - mine, h, t)}
    return out


def test_one_task_a_record_and_joins_give_what_graphs_of_documents_give(spark):
    draw = random.Random(5)
    names = ["a", "b", "c", "d", "e", "ab", "f"]
    local = sorted({(rec, draw.randrange(5), draw.choice(names), draw.choice("rs"), draw.choice(names)) for rec in range(60) for _ in range(draw.randrange(2, 22))})
    whole = {(k, h, r, t) for k, _, h, r, t in local}
    private = {x for x in sorted(whole) if draw.random() < 0.35}
    want = open_plainly(local, private, whole)
    assert len(want) > 20
    trip = "h string, r string, t string"
    nulls = [(0, None, "r", "a"), (1, "a", "r", None)]
    frames = [spark.createDataFrame([*local, (0, 1, None, "r", "a")], f"rec long, ctx_pos int, {trip}"), *(spark.createDataFrame([*sorted(x), *nulls], f"rec long, {trip}") for x in (private, whole))]
    for largest in (500_000, 0, 9):
        got = [tuple(r) for r in evalsets.inference_open(*frames, largest=largest).select("rec", "ctx_pos", "h", "t").collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("places", [1, 2, 7, 64])
def test_graphs_without_the_edges_of_a_place(places):
    draw = random.Random(places)
    edges = [(draw.randrange(12), draw.randrange(12), draw.sample(range(places), draw.randrange(places + 1))) for _ in range(14)]
    asked, want, key = [[] for _ in range(places)], set(), 0
    for at in range(places):
        label = list(range(12))
        for a, b, gaps in edges:
            if at not in gaps:
                label = [label[a] if x == label[b] else x for x in label]
        for _ in range(5):
            start, goals = draw.randrange(12), draw.sample(range(12), 2)
            asked[at].append((start, goals, key))
            want |= {key} if any(label[g] == label[start] for g in goals) else set()
            key += 1
    assert evalsets.connected_without(12, edges, asked) == want
    assert evalsets.connected_without(3, [], []) == set()


def test_records_are_judged_where_they_lie(spark, tiny, monkeypatch):
    """Without a copy of all triples or of what joins make of them."""

    def none(*_):
        raise AssertionError("cut")

    for module, cut in ((evalsets, "checkpointed"), (graph, "checkpointed"), (bridge, "written")):
        monkeypatch.setattr(module, cut, none)
    got = {r.rec for r in catalogue.QUERIES["inference_attack"](spark, tiny).collect()}
    monkeypatch.undo()
    triples, private, public = bridge.graphs(spark, tiny)
    assert got == {r.rec for r in evalsets.inference_open(triples, private, private.unionByName(public), largest=0).collect()}


def test_larger_records_pass_whole_and_smaller_ones_are_chosen_from_whole(spark, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sizes = [1, 2, 30, 9, 10, 8, 1, 31, 0, 9, 7, 7, 12]
        rows = spark.createDataFrame([(k or None, i) for k, n in enumerate(sizes) for i in range(n)], "rec long, i int").coalesce(1)
        got = graph.chosen(rows, "rec", lambda table, bounds: [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b) if table.column("i")[i].as_py() == b - a - 1], 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k or None, i, n <= 9) for k, n in enumerate(sizes) for i in range(n) if n > 9 or i == n - 1]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
