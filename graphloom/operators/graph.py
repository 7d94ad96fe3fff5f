"""Undirected reachability inside records.

A record's graph usually fits in a task (a record is a question with its documents), and there are many
records. So components are labelled in Arrow batches of many whole graphs; a record that is too
large for that is labelled by rounds of star contraction over all tasks. Reachability asks whether a
node of the start's component equals, contains or is contained in the goal: an equality join, then an
index of names. Only the goal is tested so, and the start itself counts as visited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from .containment import contained
from .joins import names_match
from .lineage import checkpointed, written

#: Edges of one graph that a task labels, and edges of many graphs that it labels at a time.
LARGEST, AT_ONCE = 500_000, 100_000
#: Triples of a record whose names a task compares with one another, so the work is their number squared.
LARGEST_NAMED = 5_000


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def edges_of(triples: DataFrame, keys: list[str]) -> DataFrame:
    """Triples as edges (keys, u, v)."""
    return triples.select(*keys, F.col("h").alias("u"), F.col("t").alias("v"))


def adjacency(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of every edge, repeats kept."""
    return edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))


def star_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, comp) for all nodes that an edge (keys, u, v) links to another; comp is the smallest node reachable.

    For graphs of any size: alternates large and small stars. Every node links its larger (then its
    smaller) neighbours to the smallest neighbour, until nothing changes; each round is cut in the shared
    folder. Hubs are met by partial aggregation and by joins that can be split.
    """
    named = lambda df, u, v: df.select(*keys, u.alias("u"), v.alias("v"))
    edges = checkpointed(named(edges, F.greatest("u", "v"), F.least("u", "v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(named(edges, F.col("v"), F.col("u")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = named(both.join(least, [*keys, "u"]).where("v > u"), F.col("v"), F.col("m")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = named(large.join(low, [*keys, "u"]), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")), F.col("m"))
        edges = checkpointed(small.where("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    leaf, root = (edges.select(*keys, F.col(c).alias("node"), F.col("v").alias("comp")) for c in "uv")
    return leaf.unionByName(root.distinct())


def components(edges: DataFrame, keys: list[str], largest: int = LARGEST) -> DataFrame:
    """(keys, node, comp): comp is the smallest node, in code-point order, of the node's component; without keys all edges are one graph.

    Graphs of at most ``largest`` edges are labelled in batches by a task, larger ones by star contraction.
    """
    plain = checkpointed(edges.select(*keys, "u", "v").where("u is not null and v is not null").distinct())
    giant = plain.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > largest).drop("n") if keys else plain.limit(1)
    if giant.isEmpty() or (not keys and plain.count() <= largest):
        return _grouped(plain, keys)
    giant = checkpointed(giant) if keys else None
    big = plain.join(giant, keys, "left_semi") if keys else plain
    nodes = big.select(*keys, F.col("u").alias("node")).unionByName(big.select(*keys, F.col("v").alias("node"))).distinct()
    labelled = nodes.join(star_components(big, keys), [*keys, "node"], "left").withColumn("comp", F.coalesce("comp", "node"))
    return _grouped(plain.join(giant, keys, "left_anti"), keys).unionByName(labelled) if keys else labelled


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; the first row's do."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column[:-1], column[1:]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _label(table: pa.Table, keys: list[str]) -> pa.Table:
    """The labelled nodes of whole graphs, whose rows are sorted by keys; all graphs at once."""
    new = _changes(table, keys)
    graph = np.cumsum(new) - 1
    names = pa.concat_arrays([table.column(c).combine_chunks() for c in "uv"]).dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cells, at = np.unique(np.r_[graph, graph] * len(order) + rank[names.indices.to_numpy()], return_inverse=True)
    i, j, label = at[: len(table)], at[len(table) :], np.arange(len(cells))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    sorted_names, mine = names.dictionary.take(pa.array(order)), cells % len(order)
    columns = {k: table.column(k).take(pa.array(np.flatnonzero(new)[cells // len(order)])) for k in keys}
    return pa.table({**columns, "node": sorted_names.take(pa.array(mine)), "comp": sorted_names.take(pa.array(mine[label]))})


def _grouped(plain: DataFrame, keys: list[str]) -> DataFrame:
    """Labels graphs that fit in a task: those of a partition together, a bounded number of edges and at least one graph at a time."""
    kind = plain.schema["u"].dataType.simpleString()
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in keys), f"node {kind}", f"comp {kind}"])
    names = [f.name for f in plain.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= AT_ONCE:
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_changes(table, names))[-1])
                if last:
                    yield from _label(table.slice(0, last), names).to_batches()
                held = table.slice(last).to_batches()
        if held and sum(map(len, held)):
            yield from _label(pa.Table.from_batches(held), names).to_batches()

    return plain.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl) if keys else plain.coalesce(1).mapInArrow(run, ddl)


def reachable(pairs: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The (keys, a, b) of ``pairs``, distinct, for which b, or a name alike, is reached from a.

    Goals that are nodes of the start's component are found by an equality join; the others by an index
    of names that hold one another, in both directions, inside of the component.
    """
    scope = [*keys, "comp"]
    asked = pairs.select(*keys, "a", "b").distinct()
    at_once = asked.where(names_match(F.col("a"), F.col("b")))
    rest = checkpointed(asked.where(~names_match(F.col("a"), F.col("b"))).join(labelled.select(*keys, F.col("node").alias("a"), "comp"), [*keys, "a"]))
    nodes = labelled.select(*scope, F.col("node").alias("name"))
    goals = rest.select(*scope, F.col("b").alias("name")).distinct()
    equal = goals.join(nodes, [*scope, "name"], "left_semi")
    open_ = checkpointed(goals.join(nodes, [*scope, "name"], "left_anti"))
    near = checkpointed(nodes.join(open_.select(*scope).distinct(), scope, "left_semi"))
    inside = contained(open_, near, scope).select(*scope, F.col("short").alias("name"))
    around = contained(near, open_, scope).select(*scope, F.col("long").alias("name"))
    hit = equal.unionByName(inside).unionByName(around).distinct().withColumnRenamed("name", "b")
    return at_once.unionByName(rest.join(hit, [*scope, "b"], "left_semi").select(*keys, "a", "b"))


def chosen(rows: DataFrame, rec: str, choose: Callable[[pa.Table, list[int]], list[int]], largest: int) -> DataFrame:
    """The rows that ``choose`` picks of each record, with judged; of a record of more than ``largest`` rows all, with judged false.

    The rows of a record have to lie in one partition. ``choose`` gets many whole records at once and where each begins
    (at last the end). A larger record passes through in pieces, so a task never holds more than ``largest`` rows of one.
    """
    out = StructType()
    for f in rows.schema.fields:
        out.add(f.name, f.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        passing: list = []
        for batch in chain(batches, [None]):
            held += [batch] if batch is not None else []
            n = sum(map(len, held))
            if n == 0 or (batch is not None and n < AT_ONCE):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.append(np.flatnonzero(_changes(table, [rec])), n)
            sizes = np.diff(starts)
            large = sizes > largest
            large[0] |= passing == [table.column(rec)[0].as_py()]
            # The last record may go on in the next batch; what is known to be too large does not wait for it.
            end = n if batch is None or large[-1] else int(starts[-2])
            passing = [table.column(rec)[n - 1].as_py()] if large[-1] else []
            held = table.slice(end).to_batches()
            whole = sizes[: len(sizes) if end == n else -1]
            over = np.repeat(large[: len(whole)], whole)
            table = table.slice(0, end)
            some = table.filter(pa.array(~over)) if over.any() else table
            bounds = [0, *np.cumsum(whole[~large[: len(whole)]]).tolist()]
            for part, judged in ((some.take(pa.array(choose(some, bounds), pa.int64())), True), (table.filter(pa.array(over)), False)):
                yield from part.append_column("judged", pa.array(np.full(len(part), judged))).to_batches()

    return rows.sortWithinPartitions(rec).mapInArrow(run, out.add("judged", BooleanType()))


def alike(a: str, b: str) -> bool:
    return a in b or b in a


def leak_filter(private: DataFrame, public: DataFrame, rec: str = "rec", largest: int = LARGEST_NAMED) -> DataFrame:
    """Private triples whose ends the public graph does not connect."""
    rows = private.withColumn("hidden", F.lit(True)).unionByName(public.select(rec, "h", "t").withColumn("hidden", F.lit(False)), allowMissingColumns=True)
    return unleaked(rows.repartition(rec), rec, largest)


def unleaked(rows: DataFrame, rec: str = "rec", largest: int = LARGEST_NAMED) -> DataFrame:
    """leak_filter() of rows with hidden (whether a triple is private); those of a record lie in one partition.

    A record of at most ``largest`` triples is judged in one task, larger ones by joins over all tasks.
    """

    def choose(table: pa.Table, bounds: list[int]) -> list[int]:
        h, t, hidden = (table.column(c).to_pylist() for c in ("h", "t", "hidden"))
        known = table.column(rec).is_valid().to_pylist()
        kept = []
        for a, b in pairwise(bounds):
            shown, members, told = UnionFind(), defaultdict(list), {}
            for i in range(a, b):
                if not hidden[i] and h[i] is not None and t[i] is not None:
                    shown.join(h[i], t[i])
            for name in list(shown.up):
                members[shown.find(name)].append(name)
            for i in range(a, b):
                if not hidden[i]:
                    continue
                u, v = h[i], t[i]
                leaks = known[a] and u is not None and v is not None
                if leaks and not alike(u, v):
                    root = shown.find(u) if u in shown.up else None
                    if (leaks := told.get((root, v))) is None:
                        leaks = told[root, v] = any(alike(n, v) for n in members.get(root, ()))
                if not leaks:
                    kept.append(i)
        return kept

    out = written(chosen(rows, rec, choose, largest))
    small, large = out.where("judged").drop("judged", "hidden"), out.where("not judged").drop("judged")
    if large.isEmpty():
        return small
    return small.unionByName(_unleaked_by_joins(large.where("hidden").drop("hidden"), large.where("not hidden"), rec))


def _unleaked_by_joins(private: DataFrame, public: DataFrame, rec: str) -> DataFrame:
    """leak_filter() for records whose names no task compares with one another."""
    labelled = components(edges_of(public, [rec]), [rec])
    leaks = reachable(private.select(rec, F.col("h").alias("a"), F.col("t").alias("b")), labelled, [rec])
    return private.join(leaks.select(rec, F.col("a").alias("h"), F.col("b").alias("t")), [rec, "h", "t"], "left_anti").select(*private.columns)
