"""A Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

Rows are numbered by a range partitioning, in which one row per partition and group crosses edges. The
trees grow in Pregel-style supersteps over RDDs. A vertex is a place in a level; its messages go to the
partition of the block of ``FAN`` to the power of ``DEPTH`` places that it lies in, where children message their parents,
parents whose children are complete hash them and go on as children themselves, until the block's
one root messages the next superstep. So a superstep climbs ``DEPTH`` levels for one exchange, and a
block is bounded whatever a group holds. Reverse supersteps hand the paths of siblings down: a block
gets its root's path from above, and every child its parent's path with its own siblings before it.
At the leaves the paths are folded again and held against the root.

Every superstep's vertices are cut in the shared folder, so a lost executor costs its part of one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

FAN = 2
DEPTH = 12
#: Numbers of groups in partitions that go to every task at most.
MANY = 100_000
#: What stands for an absent value.
ABSENT = "-"
#: A path: for each level, from the lowest, the siblings before and those after, as hex digits.
Path = tuple[tuple[str, str], ...]
Key = tuple[str, int]


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; a null as ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit(ABSENT)).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_digest(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with place, from 0 in each group in the order given, and n, the group's size; nulls come first."""
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    dealt = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    keyed = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    runs = keyed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    w = Window.partitionBy(group)
    before = F.sum("size").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    known = checkpointed(runs.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(w).alias("n")))
    few = F.broadcast(known) if known.count() <= MANY else known
    return keyed.join(few, [group, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def levels(nodes: list[str], n: int, depth: int) -> tuple[list[list[str]], int]:
    """The levels of a block from its lowest nodes up, and how many nodes the highest of them has in the whole tree of ``n``."""
    out = [nodes]
    for _ in range(depth):
        if n == 1:
            break
        low = out[-1]
        out.append([digest("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
        n = -(-n // FAN)
    return out, n


def paths(nodes: list[str], n: int, above: Path, depth: int) -> Iterator[Path]:
    """The whole path of each of a block's lowest nodes."""
    made, _ = levels(nodes, n, depth)
    known = [above]
    for low in made[-2::-1]:
        known = [(("".join(low[i - i % FAN : i]), "".join(low[i + 1 : i - i % FAN + FAN])), *known[i // FAN]) for i in range(len(low))]
    yield from known


def fold(leaf: str, path: Path) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _spread(key: Key) -> int:
    """Where a key's messages go, alike in every process."""
    return zlib.crc32(f"{key[1]} {key[0]}".encode())


STATE = "group string, block long, n long, nodes array<string>, marks array<long>, claims array<string>"


def delivered(messages: RDD, like: DataFrame, partitions: int, block: int) -> DataFrame:
    """Messages (group, n, place, digest, mark, claim) in the blocks that they go to, cut in the shared folder."""

    def gathered(item: tuple[Key, Iterable[tuple]]) -> tuple:
        (group, at), got = item
        got = sorted(got, key=lambda x: x[0])
        return group, at, got[0][1], *([x[k] for x in got] for k in (2, 3, 4))

    dealt = messages.map(lambda m: ((m[0], m[2] // block), (m[2], m[1], *m[3:]))).groupByKey(partitions, _spread).map(gathered)
    return checkpointed(like.sparkSession.createDataFrame(dealt, STATE, verifySchema=False))


def upward(leaves: DataFrame, partitions: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of each superstep, (group, digest, step) that remain) of leaves (group, n, place, digest, mark, claim)."""

    def climb(row: Row) -> tuple[str, int, int, str]:
        made, n = levels(row.nodes, row.n, depth)
        return row.group, n, row.block, made[-1][0]

    most = leaves.agg(F.max("n")).first()[0] or 0
    block = FAN**depth
    messages, states, remain = leaves.select("group", "n", "place", "digest", "mark", "claim").rdd.map(tuple), [], []
    while True:
        states.append(delivered(messages, leaves, partitions, block))
        climbed = checkpointed(leaves.sparkSession.createDataFrame(states[-1].rdd.map(climb), "group string, n long, place long, digest string", verifySchema=False))
        remain.append(climbed.where("n = 1").select("group", "digest", F.lit(len(states) - 1).alias("step")))
        if most <= block:
            return states, reduce(DataFrame.unionByName, remain)
        messages = climbed.where("n > 1").rdd.map(lambda r: (*r, None, None))
        most = -(-most // block)


def downward(states: list[DataFrame], roots: RDD, partitions: int, depth: int) -> RDD:
    """(mark, digest, claim, path, news) for every leaf; roots: ((group, step), (path, news)) of what remained of the groups."""

    def spread(item: tuple) -> Iterator[tuple]:
        (group, at), ((n, nodes, marks, claims), (path, news)) = item
        for i, own in enumerate(paths(nodes, n, path, depth)):
            yield (group, at * FAN**depth + i), (own, news, nodes[i], marks[i], claims[i])

    def of_step(step: int) -> RDD:
        return roots.filter(lambda x: x[0][1] == step).map(lambda x: ((x[0][0], 0), x[1]))

    arrived = None
    for step in range(len(states) - 1, -1, -1):
        known = of_step(step) if arrived is None else of_step(step).union(arrived.mapValues(lambda x: x[:2]))
        blocks = states[step].rdd.map(lambda r: ((r.group, r.block), (r.n, r.nodes, r.marks, r.claims)))
        arrived = blocks.join(known, partitions).flatMap(spread)
    return arrived.map(lambda x: (x[1][3], x[1][2], x[1][4], x[1][0], x[1][1]))


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, group_col: str = "lang", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    leaf is the digest of a row, claimed what is held against the tree in its place. Leaves of a group
    ascend by id, nulls first, rows that share an id by their digests, then by what is claimed; every ``FAN`` consecutive ones,
    the last run may be shorter, even one, become one digest, until one remains, the subroot. The
    subroots, ordered by group (nulls first, then by bytes), become the root likewise. proof_sha256 is the digest of a leaf's siblings,
    level by level; folded_root folds them with the claimed digest. An empty table gives an empty
    result. Only the named columns are looked at; where the id's own name is one of the result's, that one gets a ``_`` before it.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.concat(F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(group_col).cast("string"), F.lit("")))
    claim = F.coalesce(claimed, leaf) if claimed is not None else leaf
    plain = checkpointed(docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf.alias("digest"), claim.alias("claim")))
    marked = plain.withColumn("mark", F.monotonically_increasing_id())
    states, subroots = upward(numbered(marked, "group", ["id", "digest", "claim", "mark"]), partitions, depth)
    ranked = numbered(subroots.withColumnRenamed("group", "name").withColumn("group", F.lit("")), "group", ["name"])
    tops = checkpointed(ranked.withColumn("mark", F.col("place")).withColumn("claim", F.col("digest")))
    top_states, top = upward(tops, partitions, depth)
    ends = top.rdd.map(lambda r: ((r.group, r.step), ((), r.digest)))
    told = downward(top_states, ends, partitions, depth).map(lambda x: (x[0], (x[3], (x[1], x[4]))))
    roots = tops.rdd.map(lambda r: (r.mark, (r.name, r.step))).join(told, partitions).map(lambda x: x[1])

    def proven(leaf: tuple) -> tuple:
        mark, own, claim, path, (subroot, root) = leaf
        return mark, own, subroot, root, digest("".join(a + b for a, b in path)), fold(claim, path)

    out = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    known = spark.createDataFrame(downward(states, roots, partitions, depth).map(proven), f"mark long, {' string, '.join(out)} string", verifySchema=False)
    met = marked.select("mark", F.col("id").alias("own_id")).join(known, "mark")
    return met.select(F.col("own_id").alias(id_col), *(F.col(c).alias(fresh(c, [id_col])) for c in out), (F.col("folded_root") == F.col("root")).alias(fresh("verified", [id_col])))
