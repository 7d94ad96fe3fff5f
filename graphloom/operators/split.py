"""Splitting a record's graph into a private and a public part.

With question-answer vetoes the outcome depends on the order of the triples, so a record is split in
one place: records are groups, and inside of one the private graph grows in an incremental union-find.
"""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import UnionFind, alike, components, edges_of, reachable
from .joins import relation_tail_conflicts

STATS = ("sampled_requested", "private_initial", "qa_rejected", "private_promoted", "private_filtered", "private_final", "public_final")
FLAGS = "rec long, pos int, h string, r string, t string, part string, flag int, " + ", ".join(f"{s} int" for s in STATS)


class Graph(UnionFind):
    """Union-find that also lists the nodes of a component."""

    def __init__(self) -> None:
        super().__init__()
        self.members: dict[str, set[str]] = {}

    def add(self, a: str, b: str) -> None:
        x, y = self.find(a), self.find(b)
        mx, my = self.members.setdefault(x, {x}), self.members.setdefault(y, {y})
        self.join(x, y)
        if x != y:
            root = self.find(x)
            for m in (self.members.pop(x), self.members.pop(y)):
                self.members.setdefault(root, set()).update(m)

    def nodes(self, start: str) -> set[str]:
        return self.members.get(self.find(start), {start}) if start in self.up else {start}

    def reaches(self, start: str, goal: str) -> bool:
        return any(alike(n, goal) for n in self.nodes(start))

    def reaches_with(self, start: str, goal: str, edge: tuple[str, str]) -> bool:
        """As reaches(), were the edge there too."""
        seen = self.nodes(start)
        a, b = edge
        if a in seen or b in seen:
            seen = seen | self.nodes(a) | self.nodes(b)
        return any(alike(n, goal) for n in seen)


def split_record(triples: list[tuple[str, str, str]], drawn: list[int], checks: list[tuple[str, str]]) -> tuple[list[str], int, dict[str, int]]:
    """The part of each triple (private, public or leaked), how often a veto fell, and counts.

    Drawn triples become private unless that would connect an entity with an answer; then, until
    nothing changes, so do triples that conflict with a private one by relation and tail or whose ends
    the private graph connects. At last private triples that the public graph connects are leaked.
    """
    graph, heads = Graph(), defaultdict(set)
    part, vetoed, flag = ["public"] * len(triples), set(), 0

    def harms(edge: tuple[str, str]) -> bool:
        return any(graph.reaches_with(e, a, edge) for e, a in checks)

    def hide(i: int) -> None:
        h, r, t = triples[i]
        graph.add(h, t)
        heads[r, t].add(h)
        part[i] = "private"

    for i in drawn:
        if harms((triples[i][0], triples[i][2])):
            vetoed.add(i)
            flag += 1
        else:
            hide(i)
    initial, promoted, changed = part.count("private"), 0, True
    while changed:
        changed = False
        for i, (h, r, t) in enumerate(triples):
            if part[i] != "public" or not (any(alike(h, x) for x in heads.get((r, t), ())) or graph.reaches(h, t)):
                continue
            if harms((h, t)):
                if i not in vetoed:
                    vetoed.add(i)
                    flag += 1
                continue
            hide(i)
            promoted += 1
            changed = True
    shown = Graph()
    for p, (h, _, t) in zip(part, triples, strict=True):
        if p == "public":
            shown.add(h, t)
    hidden = part.count("private")
    for i, (h, _, t) in enumerate(triples):
        if part[i] == "private" and shown.reaches(h, t):
            part[i] = "leaked"
    counts = (len(drawn), initial, len(vetoed), promoted, part.count("leaked"), hidden - part.count("leaked"), part.count("public"))
    return part, flag, dict(zip(STATS, counts, strict=True))


def split_graph(merged: DataFrame, checks: DataFrame | None = None, rate: float = 0.25, seed: int = 42) -> DataFrame:
    """rec, pos, h, r, t, part, flag and the counts of each record.

    merged: rec, pos (position in the record's graph, from 0), h, r, t and sampled. Draws come in
    order of ``draw`` if there is such a column, else of position. checks: rec, entity, answer.
    """
    draw = F.col("draw") if "draw" in merged.columns else F.when(F.col("sampled"), F.col("pos"))
    rows = merged.select("rec", "pos", "h", "r", "t", draw.cast("int").alias("draw"))
    asked = (checks if checks is not None else merged.limit(0).select("rec", F.col("h").alias("entity"), F.col("t").alias("answer"))).select(F.col("rec").alias("asked"), "entity", "answer")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items = sorted(left.to_pylist(), key=lambda x: x["pos"])
        pairs = [(x["entity"], x["answer"]) for x in right.to_pylist() if x["entity"] and x["answer"]]
        order = sorted((i for i, x in enumerate(items) if x["draw"] is not None), key=lambda i: items[i]["draw"])
        part, flag, stats = split_record([(x["h"], x["r"], x["t"]) for x in items], order, pairs)
        out = {k: [x[k] for x in items] for k in ("rec", "pos", "h", "r", "t")} | {"part": part, "flag": [flag] * len(items)} | {k: [v] * len(items) for k, v in stats.items()}
        kinds = {"rec": pa.int64(), "h": pa.string(), "r": pa.string(), "t": pa.string(), "part": pa.string()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items()})

    return rows.groupBy("rec").cogroup(asked.groupBy("asked")).applyInArrow(run, FLAGS)


def replayed_draws(sizes: list[int], rate: float, seed: int = 42) -> list[list[int]]:
    """The draws that one generator, shared by all records in order, makes for records of these sizes."""
    rng = random.Random(seed)
    return [rng.sample(range(n), int(n * rate)) for n in sizes]


def promote_round(public: DataFrame, private: DataFrame, rec: str = "rec") -> DataFrame:
    """Public triples that one pass without vetoes hides, against a frozen private graph; with the reason."""
    rows = public.select(rec, "h", "r", "t").distinct()
    conflict = relation_tail_conflicts(rows, private, rec).withColumn("conflict", F.lit(1)).withColumn("path", F.lit(0))
    joined = reachable(rows.select(rec, F.col("h").alias("a"), F.col("t").alias("b")), components(edges_of(private, [rec]), [rec]), [rec])
    path = rows.join(joined.select(rec, F.col("a").alias("h"), F.col("b").alias("t")), [rec, "h", "t"]).select(*rows.columns).withColumn("conflict", F.lit(0)).withColumn("path", F.lit(1))
    return conflict.unionByName(path).groupBy(rec, "h", "r", "t").agg(F.max("conflict").alias("conflict"), F.max("path").alias("path"))
