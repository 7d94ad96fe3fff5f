"""The promotion closure without question-answer vetoes.

A public triple is hidden with a private one of its relation and tail whose head is alike, or once
private triples connect its head with its tail or a name alike. Without vetoes the rule only ever
adds, so the fixed point does not depend on any order. A record of at most ``LARGEST_RECORD`` triples is closed
in one task, many records in a batch, and no index of names is built. A larger one is closed by
semi-naive rounds over all tasks:

* heads that are alike under one relation and tail hide together, so such classes are made once, and so
  is the relation of tails with the nodes alike;
* a round's new private edges are contracted to the components that there are and labelled on their own;
* only tails and heads whose label changed are asked again.

There everything is a join or an aggregation; a record may be as large as the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .containment import alike_names
from .graph import UnionFind, components, reachable
from .joins import names_match
from .lineage import checkpointed, written

UNIT = ["rec", "r", "t", "unit"]
#: Triples of one record that a task closes; its names are compared with one another, so the work is their number squared.
LARGEST_RECORD = 5_000


def _units(rows: DataFrame) -> DataFrame:
    """The rows with unit: rows of one record, relation, tail and unit are hidden together."""
    scope = ["rec", "r", "t"]
    heads = rows.select(*scope, F.col("h").alias("name")).distinct()
    # Only tails with several heads can have heads alike.
    several = heads.join(heads.groupBy(*scope).count().where("count > 1").drop("count"), scope, "left_semi")
    pairs = alike_names(several, several, scope).where("goal < node")
    classes = components(pairs.select(*scope, F.col("goal").alias("u"), F.col("node").alias("v")), scope)
    return rows.join(classes.select(*scope, F.col("node").alias("h"), F.col("comp").alias("unit")), [*scope, "h"], "left").withColumn("unit", F.coalesce("unit", "h"))


def _relabelled(labels: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all labels (rec, node, comp), those that changed) once the edges (rec, u, v) are there too."""
    if labels is None:
        first = checkpointed(components(edges, ["rec"]))
        return first, first
    end = lambda c: labels.select("rec", F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    met = edges.join(end("u"), ["rec", "u"], "left").join(end("v"), ["rec", "v"], "left")
    merged = checkpointed(components(met.select("rec", F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v")), ["rec"]))
    moved = labels.join(merged.select("rec", F.col("node").alias("comp"), F.col("comp").alias("new")), ["rec", "comp"], "left")
    fresh = merged.join(labels.select("rec", "node"), ["rec", "node"], "left_anti").select("rec", "node", "comp", F.lit(True).alias("changed"))
    kept = moved.select("rec", "node", F.coalesce("new", "comp").alias("comp"), F.coalesce(F.col("new") != F.col("comp"), F.lit(False)).alias("changed"))
    whole = checkpointed(kept.unionByName(fresh))
    return whole.drop("changed"), whole.where("changed").drop("changed")


def _alike(a: str, b: str) -> bool:
    return a in b or b in a


def close_record(triples: list[tuple[str, str, str, bool]]) -> list[str]:
    """The parts of one record's triples (h, r, t, sampled). A null end is in no graph, a null relation like no other."""
    whole = [i for i, (h, _, t, _) in enumerate(triples) if h is not None and t is not None]
    names = {x for i in whole for x in (triples[i][0], triples[i][2])}
    near = {t: [n for n in names if n in t or t in n] for t in {triples[i][2] for i in whole}}
    mates = defaultdict(list)
    for i in whole:
        if triples[i][1] is not None:
            mates[triples[i][1:3]].append(i)
    hidden, private, shown = {i for i, x in enumerate(triples) if x[3]}, UnionFind(), UnionFind()
    todo = [i for i in whole if i in hidden or _alike(triples[i][0], triples[i][2])]
    hidden.update(todo)
    met = lambda graph, h, t: any(graph.find(n) == graph.find(h) for n in near[t])
    while todo:
        while todo:
            h, r, t, _ = triples[todo.pop()]
            private.join(h, t)
            more = [i for i in mates.get((r, t), ()) if i not in hidden and _alike(triples[i][0], h)]
            hidden.update(more)
            todo += more
        todo = [i for i in whole if i not in hidden and met(private, triples[i][0], triples[i][2])]
        hidden.update(todo)
    for i in whole:
        if i not in hidden:
            shown.join(triples[i][0], triples[i][2])
    ended = set(whole)
    leaked = lambda i: i in ended and (_alike(triples[i][0], triples[i][2]) or met(shown, triples[i][0], triples[i][2]))
    return ["public" if i not in hidden else "leaked" if leaked(i) else "private" for i in range(len(triples))]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closes packed records (rec, rows); one that comes without rows is too large and leaves a row without a part."""
    for batch in batches:
        rows, n = batch.column("rows"), np.diff(batch.column("rows").offsets.to_numpy())
        flat = rows.flatten()
        columns = {c: flat.field(c) for c in ("pos", "h", "r", "t", "sampled")}
        triples = list(zip(*(columns[c].to_pylist() for c in ("h", "r", "t", "sampled")), strict=True))
        parts, at = [], 0
        for rec, k in zip(batch.column("rec").to_pylist(), n, strict=True):
            # A record without a number is none: nothing is known to belong together.
            parts += close_record(triples[at : at + k]) if rec is not None else ["public"] * int(k)
            at += int(k)
        recs = batch.column("rec").take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([recs, *(columns[c] for c in ("pos", "h", "r", "t")), pa.array(parts, pa.string())], ["rec", "pos", "h", "r", "t", "part"])
        giant = batch.column("rec").take(pa.array(np.flatnonzero(n == 0)))
        if len(giant):
            nothing = [pa.nulls(len(giant), columns[c].type) for c in ("pos", "h", "r", "t")]
            yield pa.RecordBatch.from_arrays([giant, *nothing, pa.nulls(len(giant), pa.string())], ["rec", "pos", "h", "r", "t", "part"])


def promotion_closure(merged: DataFrame, largest: int = LARGEST_RECORD) -> DataFrame:
    """rec, pos, h, r, t, part (private, public or leaked) of rec, pos, h, r, t, sampled.

    Sampled triples are private and the closure adds others; private ones whose ends the remaining public
    graph connects are leaked. Repeated triples share their part. An empty table gives an empty result.
    """
    rows = merged.select("rec", "pos", "h", "r", "t", F.coalesce("sampled", F.lit(False)).alias("sampled"))
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("rec")))
    # Rows of records that are too large are not packed. Those without a record are not closed, so they may be cut anywhere.
    cut = F.when(F.col("rec").isNull(), F.floor(F.col("pos") / LARGEST_RECORD)).alias("cut")
    packed = F.collect_list(F.when((F.col("n") <= largest) | F.col("rec").isNull(), F.struct("pos", "h", "r", "t", "sampled"))).alias("rows")
    small = counted.groupBy("rec", cut).agg(packed).drop("cut")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    judged = written(small.mapInArrow(_close, ", ".join(f"{c} {kinds[c]}" for c in ("rec", "pos", "h", "r", "t")) + ", part string"))
    told = judged.where("part is not null")
    giants = judged.where("part is null").select("rec")
    if giants.isEmpty():
        return told
    return told.unionByName(_close_by_joins(rows.join(checkpointed(giants), "rec", "left_semi")))


def _close_by_joins(merged: DataFrame) -> DataFrame:
    """promotion_closure() of records that no task holds."""
    merged = checkpointed(merged)
    ended = F.col("h").isNotNull() & F.col("t").isNotNull()
    bare = merged.where(~ended).select("rec", "pos", "h", "r", "t", F.when(F.col("sampled"), "private").otherwise("public").alias("part"))
    # A null relation is like no other, so it gets a name of its own.
    rows = checkpointed(_units(merged.where(ended).withColumn("known_r", F.col("r")).withColumn("r", F.coalesce("r", F.concat(F.lit("\0"), F.col("pos").cast("string"))))))
    # A start counts as visited: a head that is alike its own tail reaches it without any edge.
    fresh = checkpointed(rows.where(F.col("sampled") | names_match(F.col("h"), F.col("t"))).select(*UNIT).distinct())
    nodes = rows.select("rec", F.explode(F.array("h", "t")).alias("name")).distinct()
    near = alike_names(rows.select("rec", F.col("t").alias("name")).distinct(), nodes, ["rec"])
    asked = rows.join(fresh, UNIT, "left_anti").select(*UNIT, "h").distinct().join(near.withColumnRenamed("goal", "t"), ["rec", "t"]).where("h <> node")
    pairs = checkpointed(asked.select(*UNIT, "h", F.col("node").alias("n")))
    hidden, labels = fresh, None
    while True:
        edges = rows.join(fresh, UNIT, "left_semi").select("rec", F.col("h").alias("u"), F.col("t").alias("v"))
        labels, changed = _relabelled(labels, edges)
        touched = lambda c: pairs.join(changed.select("rec", F.col("node").alias(c)), ["rec", c], "left_semi")  # noqa: E731, B023
        side = lambda c: labels.select("rec", F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))  # noqa: E731, B023
        again = touched("h").unionByName(touched("n")).join(side("h"), ["rec", "h"]).join(side("n"), ["rec", "n"])
        fresh = checkpointed(again.where("h_comp = n_comp").select(*UNIT).distinct().join(hidden, UNIT, "left_anti"))
        if fresh.isEmpty():
            break
        hidden = hidden.unionByName(fresh)
    marked = checkpointed(rows.join(hidden.withColumn("hidden", F.lit(True)), UNIT, "left").withColumn("hidden", F.coalesce("hidden", F.lit(False))))
    shown = components(marked.where("not hidden").select("rec", F.col("h").alias("u"), F.col("t").alias("v")), ["rec"])
    leaks = reachable(marked.where("hidden").select("rec", F.col("h").alias("a"), F.col("t").alias("b")), shown, ["rec"])
    told = marked.join(leaks.select("rec", F.col("a").alias("h"), F.col("b").alias("t"), F.lit(True).alias("leak")), ["rec", "h", "t"], "left")
    return bare.unionByName(told.select("rec", "pos", "h", F.col("known_r").alias("r"), "t", F.when(~F.col("hidden"), "public").when(F.col("leak"), "leaked").otherwise("private").alias("part")))
