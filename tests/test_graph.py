from __future__ import annotations

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evalsets, graph, joins, metrics, split
from graphloom.plans import bridge, catalogue

NAMES = ["A", "AB", "B", "BC", "C", "D", "E1", "E", "F"]


def reached(edges, start, goal):
    near, seen, todo = {}, {start}, deque([start])
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    while todo:
        x = todo.popleft()
        if x in goal or goal in x:
            return True
        for y in near.get(x, []):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return False


def random_graph(rng, n):
    return [(rng.choice(NAMES), rng.choice("rs"), rng.choice(NAMES)) for _ in range(n)]


def test_reachability_equals_a_search(spark):
    rng = random.Random(5)
    graphs = {rec: [(h, t) for h, _, t in random_graph(rng, rng.randint(0, 5))] for rec in range(80)}
    pairs = {(rec, rng.choice(NAMES), rng.choice(NAMES)) for rec in range(80) for _ in range(6)}
    edges = spark.createDataFrame([(rec, a, b) for rec, es in graphs.items() for a, b in es], "rec long, u string, v string")
    asked = spark.createDataFrame(sorted(pairs), "rec long, a string, b string")
    got = {tuple(r) for r in graph.reachable(asked, graph.components(edges, ["rec"]), ["rec"]).collect()}
    assert got == {p for p in pairs if reached(graphs[p[0]], p[1], p[2])}


def test_large_graphs_are_labelled_alike(spark):
    rng = random.Random(6)
    rows = [(rec, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for rec in range(4) for _ in range(10 * (rec + 1))] + [(9, "a", "a"), (9, "b", None)]
    edges = spark.createDataFrame(rows, "rec long, u string, v string").repartition(3)
    small = {tuple(r) for r in graph.components(edges, ["rec"]).collect()}
    assert {tuple(r) for r in graph.components(edges, ["rec"], largest=15).collect()} == small
    assert {tuple(r) for r in graph.components(edges, ["rec"], largest=0).collect()} == small and (9, "a", "a") in small


def plain_split(triples, drawn, checks):
    """The rule as it is told: every candidate searches the whole private graph anew."""
    private, part, vetoed, flag = [], ["public"] * len(triples), set(), 0
    harms = lambda e: any(reached([*private, e], a, b) for a, b in checks)
    edge = lambda i: (triples[i][0], triples[i][2])
    for i in drawn:
        if harms(edge(i)):
            vetoed.add(i)
            flag += 1
        else:
            part[i] = "private"
            private.append(edge(i))
    changed = True
    while changed:
        changed = False
        for i, (h, r, t) in enumerate(triples):
            if part[i] != "public":
                continue
            conflict = any(part[j] == "private" and triples[j][1:] == (r, t) and (triples[j][0] in h or h in triples[j][0]) for j in range(len(triples)))
            if not (conflict or reached(private, h, t)):
                continue
            if harms((h, t)):
                if i not in vetoed:
                    vetoed.add(i)
                    flag += 1
                continue
            part[i] = "private"
            private.append((h, t))
            changed = True
    shown = [edge(i) for i, p in enumerate(part) if p == "public"]
    return ["leaked" if p == "private" and reached(shown, *edge(i)) else p for i, p in enumerate(part)], flag


@pytest.mark.parametrize("seed", range(300))
def test_split_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    triples = random_graph(rng, rng.randint(1, 12))
    drawn = rng.sample(range(len(triples)), len(triples) // 3)
    checks = [(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(rng.randint(0, 2))]
    part, flag, stats = split.split_record(triples, drawn, checks)
    assert (part, flag) == plain_split(triples, drawn, checks)
    assert stats["private_final"] + stats["private_filtered"] + stats["public_final"] == len(triples)


def test_known_splits():
    assert split.split_record([("Q", "r", "A"), ("X", "s", "Y")], [0], [("Q", "A")])[0] == ["public", "public"]
    five = [("A", "r", "B"), ("C", "r", "D"), ("A", "x", "B"), ("C", "y", "D"), ("X", "u", "Y")]
    part, _, stats = split.split_record(five, [0, 1], [])
    assert part == ["private"] * 4 + ["public"] and stats["private_promoted"] == 2


def test_split_over_records(spark):
    rows = [(1, 0, "Q", "r", "A", True), (1, 1, "X", "s", "Y", False), (2, 0, "Q", "r", "A", True)]
    df = spark.createDataFrame(rows, "rec long, pos int, h string, r string, t string, sampled boolean")
    checks = spark.createDataFrame([(1, "Q", "A"), (2, "", "A")], "rec long, entity string, answer string")
    got = {(r.rec, r.pos): (r.part, r.flag) for r in split.split_graph(df, checks).collect()}
    assert got == {(1, 0): ("public", 1), (1, 1): ("public", 1), (2, 0): ("private", 0)}
    assert split.replayed_draws([4, 0, 9], 0.5, 42) == (lambda g: [g.sample(range(n), n // 2) for n in (4, 0, 9)])(random.Random(42))


def test_inference_set_equals_the_plain_rule(spark):
    rng = random.Random(11)
    local, private, whole, expected = [], [], [], set()
    for rec in range(120):
        triples = random_graph(rng, 8)
        hidden = set(rng.sample(triples, 3))
        docs = [[t for t in triples if rng.random() < 0.5] for _ in range(2)]
        whole += [(rec, *t) for t in triples]
        private += [(rec, *t) for t in hidden]
        local += [(rec, c, *t) for c, ts in enumerate(docs) for t in ts]
        p_edges = [(h, t) for h, _, t in hidden]
        u_edges = [(h, t) for h, _, t in triples if (h, t) not in p_edges]
        for ts in docs:
            mine = [(h, t) for h, r, t in ts if (h, r, t) in hidden]
            own = [(h, t) for h, _, t in ts if (h, t) not in mine]
            for a, b in mine:
                if not reached([e for e in p_edges if e not in mine], a, b) and reached([e for e in u_edges if e not in own], a, b):
                    expected.add(rec)
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    trip = "h string, r string, t string"
    got = evalsets.inference_open(f(local, f"rec long, ctx_pos int, {trip}"), f(private, f"rec long, {trip}"), f(whole, f"rec long, {trip}"))
    assert {r.rec for r in got.collect()} == expected and expected


def test_special_contexts(spark):
    trip = "rec long, ctx_pos int, h string, r string, t string"
    public = spark.createDataFrame([(1, 0, "A", "r", "T"), (1, 1, "B", "r", "T"), (1, 2, "B", "r", "U")], trip)
    private = spark.createDataFrame([(1, 0, "P", "q", "T"), (1, 1, "B", "r", "T"), (1, 2, "P", "q", "T")], trip)
    assert [r.ctx_pos for r in evalsets.special_contexts(public, private).collect()] == [0]


def test_connectivity_of_a_path(spark):
    trip = "rec long, h string, r string, t string"
    private = spark.createDataFrame([(1, "head", "r", "tail")], trip)
    predicted = spark.createDataFrame([(1, "head", "a", "middle"), (1, "middle", "b", "tail")], trip)
    row = metrics.connectivity(metrics.connectivity_rows(private, predicted)).first()
    assert (row.macro, row.micro) == (1.0, 1.0)


def test_retention_and_empty_references(spark):
    t3 = "rec long, ctx_pos int, h string, r string, t string"
    pred = spark.createDataFrame([(1, 0, "p0", "r", "x"), (1, 0, "p0", "r", "x"), (1, 0, "s", "r", "x")], t3)
    pub = spark.createDataFrame([(1, 0, "p0", "r", "x"), (1, 0, "p0", "r", "x"), (1, 0, "p1", "r", "x")], t3)
    docs = spark.createDataFrame([(1, 0), (1, 1)], "rec long, ctx_pos int")
    rows = {r.ctx_pos: (r.r_pub, r.r_pri) for r in metrics.retention_rows(pred, pub, pub.limit(0), docs, ["rec", "ctx_pos"]).collect()}
    assert rows == {0: (0.5, 0.0), 1: (1.0, 0.0)}


def test_positional_zip_fails_on_unequal_sides(spark):
    a = spark.createDataFrame([(0, "q"), (1, "p")], "i long, q string")
    with pytest.raises(Exception, match="no partner"):
        joins.positional_zip(a, a.limit(1), "i").collect()
    with pytest.raises(Exception, match="q differs"):
        joins.positional_zip(a, spark.createDataFrame([(0, "q"), (1, "x")], "i long, q string"), "i", ("q",)).collect()
    assert joins.positional_zip(a, a, "i", ("q",)).count() == 2


def test_log_steps_need_both_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "step long, r double")
    b = spark.createDataFrame([(1, 3.0)], "step long, s double")
    with pytest.raises(Exception, match="exactly one reward and one update"):
        joins.merge_steps(a, b).collect()


def test_pairs_of_a_large_record_are_dealt_over_tasks(spark):
    """One record has all the pairs: no task makes more than a share of them, and all are there, repeats too."""
    rows = [(1, f"e{i}") for i in range(200)] + [(1, "e0"), (1, ""), (2, "x"), (3, "alone"), (None, "n")]
    names = [(1, f"a{i}") for i in range(50)] + [(2, "y"), (2, "y"), (4, "z"), (None, "n")]
    entities, answers = spark.createDataFrame(rows, "rec long, entity string"), spark.createDataFrame(names, "rec long, answer string")
    made = joins.qa_pairs(entities, answers, pairs=500)
    want = sorted((r, e, a) for r, e in rows for k, a in names if r is not None and r == k and e)
    assert sorted(map(tuple, made.collect())) == want
    assert max(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()) < len(want) / 4


@pytest.mark.parametrize(
    ("entities", "answers"),
    [(["e"], [f"a{i}" for i in range(4000)]), (["e"] * 300, [f"a{i}" for i in range(12)]), ([f"e{i}" for i in range(12)], ["a"] * 300), ([f"e{i}" for i in range(90)], [f"a{i}" for i in range(90)])],
)
def test_pairs_are_dealt_over_tasks_by_both_sides(spark, entities, answers):
    """One entity with many answers, and repeats of one, are no task's own; a task holds a share of the answers and no more."""
    a, b = spark.createDataFrame([(1, e) for e in entities], "rec long, entity string"), spark.createDataFrame([(1, x) for x in answers], "rec long, answer string")
    made = joins.qa_pairs(a, b, pairs=100).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["entity"], r["answer"]) for r in made) == sorted((e, x) for e in entities for x in answers)
    assert max(Counter(r["task"] for r in made).values()) < len(made) / 4


def test_leaks_are_found_in_a_task_as_by_joins(spark, tiny, monkeypatch):
    rng = random.Random(11)
    graphs = {rec: ([(h, t) for h, _, t in random_graph(rng, rng.randint(0, 6))], [(h, t) for h, _, t in random_graph(rng, rng.randint(0, 6))]) for rec in range(60)}
    want = sorted((rec, i, h, t) for rec, (public, private) in graphs.items() for i, (h, t) in enumerate(private) if not reached(public, h, t))
    odd = [(None, 0, "A", "A"), (1, 90, None, "A"), (1, 91, "A", None)]
    private = spark.createDataFrame([*((rec, i, *e) for rec, (_, es) in graphs.items() for i, e in enumerate(es)), *odd], "rec long, pos int, h string, t string")
    public = spark.createDataFrame([*((rec, *e) for rec, (es, _) in graphs.items() for e in es), (None, "A", "A"), (1, None, "A")], "rec long, h string, t string")
    for largest in (5_000, 6, 0):
        out = graph.leak_filter(private, public, largest=largest)
        assert out.columns == private.columns
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*want, *odd]))

    def none(*_):
        raise AssertionError("a record that a task judges needs no copy and no join")

    monkeypatch.setattr(graph, "checkpointed", none)
    monkeypatch.setattr(bridge, "written", none)
    assert catalogue.QUERIES["leak_filter"](spark, tiny).count()
