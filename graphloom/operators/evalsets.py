"""Evaluation sets: contexts with special triples, and records open to inference."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import LARGEST, UnionFind, alike, chosen, components, edges_of, reachable
from .joins import edge_difference
from .lineage import checkpointed, written

#: What a row may be of to inference_open(): a document's triple, and a private one and any one of the record's graph.
ROLES = ("local", "private", "whole")


def is_special(public: Column, private: Column) -> Column:
    """Whether a public triple shares its tail with a private one, but not head and relation with one of that tail."""
    same_tail = lambda p: F.exists(private, lambda q: q["t"] == p["t"])
    same = lambda p: F.exists(private, lambda q: (q["t"] == p["t"]) & (q["h"] == p["h"]) & (q["r"] == p["r"]))
    return F.exists(public, lambda p: same_tail(p) & ~same(p))


def special_contexts(public: DataFrame, private: DataFrame, rec: str = "rec", ctx: str = "ctx_pos") -> DataFrame:
    """(rec, ctx) of special contexts, from local triples in long form: a semi join less an anti join."""
    tails = private.select(rec, ctx, "t").distinct()
    return public.join(tails, [rec, ctx, "t"], "left_semi").join(private.select(rec, ctx, "h", "r", "t").distinct(), [rec, ctx, "h", "r", "t"], "left_anti").select(rec, ctx).distinct()


def special_records(public: DataFrame, private: DataFrame, least: int = 2, rec: str = "rec", ctx: str = "ctx_pos") -> DataFrame:
    """Records with at least so many special contexts, and how many."""
    return special_contexts(public, private, rec, ctx).groupBy(rec).agg(F.count("*").alias("special")).where(F.col("special") >= least)


def connected_without(n: int, edges: list[tuple[int, int, list[int]]], asked: list[list[tuple[int, list[int], int]]]) -> set[int]:
    """Keys of the questions that a graph of n nodes answers with yes, each without the edges of its place.

    edges: (a, b, places at which the edge is missing). asked: for each place (start, goals, key); yes if the
    start is connected with any goal. An edge holds in the runs of places between those where it is missing; a
    tree over the places keeps each run in a few nodes, and a walk down the tree joins and takes back. So the
    work grows with the edges and their gaps, not with edges times places.
    """
    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    up, size, found = list(range(n)), [1] * n, set()

    def put(lo: int, hi: int, a: int, b: int, edge: tuple[int, int]) -> None:
        if a <= lo and hi <= b:
            spans[lo, hi].append(edge)
        elif a < hi and lo < b:
            mid = (lo + hi) // 2
            put(lo, mid, a, b, edge)
            put(mid, hi, a, b, edge)

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    def walk(lo: int, hi: int) -> None:
        joined = []
        for a, b in spans.get((lo, hi), ()):
            a, b = find(a), find(b)
            if a != b:
                a, b = (a, b) if size[a] >= size[b] else (b, a)
                up[b] = a
                size[a] += size[b]
                joined.append((a, b))
        if hi - lo == 1:
            for start, goals, key in asked[lo]:
                root = find(start)
                if any(find(g) == root for g in goals):
                    found.add(key)
        else:
            mid = (lo + hi) // 2
            walk(lo, mid)
            walk(mid, hi)
        for a, b in reversed(joined):
            up[b] = b
            size[a] -= size[b]

    if asked:
        for a, b, gaps in edges:
            at = 0
            for g in [*sorted(gaps), len(asked)]:
                if at < g:
                    put(0, len(asked), at, g, (a, b))
                at = g + 1
        walk(0, len(asked))
    return found


def open_edges(edges: list[tuple[str, str, bool, list]]) -> Iterator[tuple[object, str, str]]:
    """(ctx, h, t) open to inference in one record; edges are (h, t, private, contexts that hold the edge)."""
    whole = {k: UnionFind() for k in (False, True)}
    members: dict[bool, dict[str, list[str]]] = {k: defaultdict(list) for k in whole}
    goals: dict[tuple[bool, str, str], list[str]] = {}

    def connect(kind: bool) -> None:
        for h, t, private, _ in edges:
            if private == kind:
                whole[kind].join(h, t)
        for x in list(whole[kind].up):
            members[kind][whole[kind].find(x)].append(x)

    def near(kind: bool, h: str, t: str) -> list[str]:
        """The names alike t that h's component holds."""
        key = kind, whole[kind].find(h), t
        if key not in goals:
            goals[key] = [x for x in members[kind].get(key[1], ()) if alike(x, t)]
        return goals[key]

    # In most records the public graph gives nothing away, which is known before the graphs of documents are.
    connect(False)
    asking = [(h, t, ctxs) for h, t, private, ctxs in edges if private and ctxs and not alike(h, t) and h in whole[False].up and near(False, h, t)]
    if not asking:
        return iter(())
    connect(True)
    number = {x: i for i, x in enumerate(dict.fromkeys(x for h, t, *_ in edges for x in (h, t)))}
    places: dict[object, int] = {}
    asked: dict[bool, list[list]] = {k: [] for k in whole}
    questions = []
    for h, t, ctxs in asking:
        found = {k: [number[x] for x in near(k, h, t)] for k in whole}
        for ctx in ctxs:
            at = places.setdefault(ctx, len(places))
            for k in whole:
                if at == len(asked[k]):
                    asked[k].append([])
                asked[k][at].append((number[h], found[k], len(questions)))
            questions.append((ctx, h, t))
    gaps = lambda ctxs: [places[c] for c in ctxs if c in places]
    answer = {k: connected_without(len(number), [(number[h], number[t], gaps(ctxs)) for h, t, p, ctxs in edges if p == k], asked[k]) for k in whole}
    return (questions[i] for i in sorted(answer[False] - answer[True]))


def inference_open(local: DataFrame, private: DataFrame, whole: DataFrame, rec: str = "rec", ctx: str = "ctx_pos", largest: int = LARGEST) -> DataFrame:
    """Private edges of documents that the other documents' public graph gives away.

    (rec, ctx, h, t) of local private edges which the record's private edges outside of the document
    do not connect while its other public edges outside of it do. local: triples of documents;
    private and whole: the record's private and all triples. A null end is in no graph and asks nothing.
    """
    kind = local.schema[ctx].dataType
    role = lambda df, name: df.select(rec, F.col(ctx) if name == "local" else F.lit(None).cast(kind).alias(ctx), "h", "r", "t", *(F.lit(n == name).alias(n) for n in ROLES))
    rows = role(local, "local").unionByName(role(private, "private")).unionByName(role(whole, "whole"))
    return open_rows(rows.repartition(rec), rec, ctx, largest)


def open_rows(rows: DataFrame, rec: str = "rec", ctx: str = "ctx_pos", largest: int = LARGEST) -> DataFrame:
    """inference_open() of rows with their roles (local, private, whole: whether a row is one of each); those of a record lie in one partition.

    A record of at most ``largest`` rows is judged in one task, with each edge once beside the documents
    that hold it. Larger ones are judged by joins over all tasks, where each document has its own graph.
    """

    def choose(table: pa.Table, bounds: list[int]) -> list[int]:
        ctxs, h, r, t, local, private, whole = (table.column(c).to_pylist() for c in (ctx, "h", "r", "t", *ROLES))
        known = table.column(rec).is_valid().to_pylist()
        found = []
        for a, b in pairwise(bounds):
            if not known[a]:
                continue
            hidden = {(h[i], r[i], t[i]) for i in range(a, b) if private[i]}
            edges = {(u, v): {} for u, _, v in hidden}
            shown = {(h[i], t[i]): {} for i in range(a, b) if whole[i] and (h[i], t[i]) not in edges}
            at: dict[tuple, int] = {}
            for i in range(a, b):
                if not local[i] or ctxs[i] is None:
                    continue
                if (h[i], t[i]) in shown:
                    shown[h[i], t[i]][ctxs[i]] = None
                elif r[i] is not None and (h[i], r[i], t[i]) in hidden:
                    edges[h[i], t[i]][ctxs[i]] = None
                    at.setdefault((ctxs[i], h[i], t[i]), i)
            found += [at[x] for x in open_edges([(u, v, p, list(c)) for p, part in ((False, shown), (True, edges)) for (u, v), c in part.items()])]
        return found

    out = written(chosen(rows.where("h is not null and t is not null").select(rec, ctx, "h", "r", "t", *ROLES), rec, choose, largest))
    small, large = out.where("judged").select(rec, ctx, "h", "t"), out.where("not judged")
    return small if large.isEmpty() else small.unionByName(_open_by_joins(large, rec, ctx))


def _open_by_joins(rows: DataFrame, rec: str, ctx: str) -> DataFrame:
    """open_rows() for records whose graph no task holds.

    A pair that not even the record's whole public graph connects is dropped before any graph of a
    single document is built.
    """
    local = checkpointed(rows.where("local").select(rec, ctx, "h", "r", "t").distinct())
    private = checkpointed(rows.where("private").select(rec, "h", "r", "t").distinct())
    mine = checkpointed(local.join(private, [rec, "h", "r", "t"], "left_semi").select(rec, ctx, "h", "t").distinct())
    edge = [rec, "h", "t"]
    public = checkpointed(edge_difference(rows.where("whole").select(*edge).distinct(), private, edge))
    pairs = lambda x: x.select(rec, F.col("h").alias("a"), F.col("t").alias("b"))
    back = lambda x, *k: x.select(*k, F.col("a").alias("h"), F.col("b").alias("t"))
    likely = back(reachable(pairs(mine), components(edges_of(public, [rec]), [rec]), [rec]), rec)
    asked = checkpointed(mine.join(likely, edge, "left_semi"))
    keys = [rec, ctx]
    docs = asked.select(*keys).distinct()
    # The document's own edges leave the graphs of the record: its public ones the public graph, its private ones the private graph.
    own_public = edge_difference(local.select(*keys, "h", "t").distinct(), mine, [*keys, "h", "t"])
    other_public = edge_difference(docs.join(public, rec), own_public, [*keys, "h", "t"])
    other_private = edge_difference(docs.join(private.select(*edge).distinct(), rec), mine, [*keys, "h", "t"])
    ab = asked.select(*keys, F.col("h").alias("a"), F.col("t").alias("b"))
    shown = checkpointed(reachable(ab, components(edges_of(other_public, keys), keys), keys))
    hidden = reachable(shown, components(edges_of(other_private, keys), keys), keys)
    return back(shown.join(hidden, [*keys, "a", "b"], "left_anti"), *keys)
