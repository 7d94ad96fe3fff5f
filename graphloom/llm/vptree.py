"""Nearest neighbours by inner product with vantage-point trees, one per shard.

A vector x gets one coordinate more, sqrt(M^2 - |x|^2) with M the largest norm, and a query is scaled
to norm M with a zero there; then the largest inner product is the smallest Euclidean distance, and
the triangle inequality holds. A node compares the query's distance d to its vantage point with the
median mu: the inner side can be left out if ``factor * (d - mu)`` exceeds the distance of the k-th
best found, the outer side if ``factor * (mu - d)`` does. Factor one is exact search; a larger factor
prunes more.

Rows are dealt to shards at random, so shards are equally large whatever the ids and vectors are.
Equal vectors of a shard are one point of its tree with their ids in order. A shard's tree is built
once and written with its points; every block of queries meets every shard's tree once, and a shard
hands on its k best of each query.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARD = 8192
#: Queries that meet a shard in one task, and those of them that walk its tree at a time.
BLOCK, STRIDE = 16384, 4096
LEAF = 128
FACTOR = 1.1
SEED = 11
#: Scores closer than this share of M^2 count as possibly tied until they are computed exactly.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over the rows of a matrix, in arrays.

    A node is (vantage, mu, inner, outer); a leaf has vantage -1 and its part of ``order`` in the last two.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.points, self.order = points, order
        self.nodes = [(int(v), m, int(a), int(b)) for v, m, a, b in nodes.tolist()]


def build(points: np.ndarray, norm: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of the tree over ``points``, lifted to the sphere of radius ``norm``."""
    lift = np.sqrt(np.maximum(0, norm * norm - (points**2).sum(axis=1)))
    order, nodes = np.arange(len(points)), []

    def part(begin: int, end: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, begin, end))
        if end - begin <= LEAF:
            return me
        own = order[begin:end]
        vantage = int(rng.choice(own))
        d = np.sqrt(np.maximum(0, ((points[own] - points[vantage]) ** 2).sum(axis=1) + (lift[own] - lift[vantage]) ** 2))
        middle = len(own) // 2
        by = np.argpartition(d, middle)
        order[begin:end] = own[by]
        nodes[me] = (vantage, float(d[by[middle]]), part(begin, begin + middle), part(begin + middle, end))
        return me

    part(0, len(points))
    return order, np.array(nodes, float)


def search(tree: Tree, queries: np.ndarray, norm: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs that hold each query's k best points; inner products may tie within the slack."""
    sizes = np.sqrt((queries**2).sum(axis=1))
    scaled = queries * (norm / sizes)[:, None]
    best = np.full((len(queries), k), -np.inf)  # scaled inner products
    slack = SLACK * norm * norm
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tau(active: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * norm * norm - 2 * (best[active].min(axis=1) - slack)))

    def walk(node: int, active: np.ndarray) -> None:
        vantage, mu, inner, outer = tree.nodes[node]
        if vantage < 0:
            own = tree.order[inner:outer]
            s = scaled[active] @ tree.points[own].T
            q, p = np.nonzero(s >= best[active].min(axis=1)[:, None] - slack)
            kept.append((active[q], own[p], s[q, p]))
            both = np.concatenate([best[active], s], axis=1)
            best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            return
        d = np.sqrt(np.maximum(0, 2 * norm * norm - 2 * (scaled[active] @ tree.points[vantage])))
        near = d < mu
        for first, second, side, gap in ((inner, outer, near, mu - d), (outer, inner, ~near, d - mu)):
            if side.any():
                own, wide = active[side], gap[side]
                walk(first, own)
                more = own[factor * wide <= tau(own)]
                if len(more):
                    walk(second, more)

    walk(0, np.arange(len(queries)))
    q, p, s = (np.concatenate(x) for x in zip(*kept, strict=True))
    final = s >= best.min(axis=1)[q] - slack
    return q[final], p[final]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return dict(f)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def usable(vec: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to smaller ids.

    A query is a row for which ``is_query`` holds; its candidates are all other ids of its dimension.
    Rows with a null id, or a vector that is null, empty, zero or not finite, take no part. Scores are
    in double precision on the vectors as given. An id with several vectors is a candidate with each, and a
    query with each; an answer names an id once, with its best score, and never the query's own. No usable rows, no result.
    """
    usable_rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.size(vec_col).cast("long").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = checkpointed(usable_rows.groupBy("id", "v", "dim").agg(F.max("ask").alias("ask")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, top = rows.agg(F.count("*"), F.max(square)).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = float(top) ** 0.5 * (1 + 1e-12)
    shards = -(-count // SHARD)
    blocks = -(-max(1, rows.where("ask").count()) // BLOCK)

    def row(key: tuple, data: bytes) -> pa.Table:
        return pa.table({"dim": [key[0].as_py()], "part": [key[1].as_py()], "data": pa.array([data], pa.binary())})

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        """A shard: its points and their tree, and for each point the ids that have it, in order."""
        ids, raw = table.column("id").to_numpy(), _matrix(table.column("v"))
        by = np.argsort(ids, kind="stable")
        points, place = np.unique(raw[by], axis=0, return_inverse=True)
        members = np.argsort(place.ravel(), kind="stable")
        starts = np.searchsorted(place.ravel()[members], np.arange(len(points) + 1))
        order, nodes = build(points.astype(np.float64), norm, np.random.default_rng(SEED))
        return row(key, _pack(ids=ids[by], points=points, members=members, starts=starts, order=order, nodes=nodes))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        return row(key, _pack(ids=table.column("id").to_numpy(), vectors=_matrix(table.column("v"))))

    blob = "dim long, part long, data binary"
    index = checkpointed(rows.select("id", "v", "dim", F.floor(F.rand(SEED) * shards).cast("long").alias("part")).groupBy("dim", "part").applyInArrow(plant, blob))
    asks = rows.where("ask").select("id", "v", "dim", F.floor(F.rand(SEED + 1) * blocks).cast("long").alias("part")).groupBy("dim", "part").applyInArrow(gather, blob)
    left = index.select("dim", F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "data")
    right = asks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("part").alias("block"), "data")

    def near(tree: Tree, ids: np.ndarray, members: np.ndarray, starts: np.ndarray, queries: np.ndarray, asked: np.ndarray, ask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): of each query's best ``ask`` points the k best other ids, each once."""
        q, p = search(tree, queries, norm, ask, factor)
        # Copies of a point: its smallest ids, one more than k for the query's own.
        copies = np.minimum(starts[p + 1] - starts[p], k + 1)
        q, p, nth = np.repeat(q, copies), np.repeat(p, copies), np.concatenate([np.arange(c) for c in copies]) if len(copies) else np.zeros(0, int)
        who = ids[members[starts[p] + nth]]
        other = who != asked[q]
        q, p, who = q[other], p[other], who[other]
        score = np.concatenate([np.zeros(0), *((tree.points[p[i : i + 65536]] * queries[q[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536))])
        order = np.lexsort((-score, who, q))
        q, who, score = q[order], who[order], score[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (who[1:] != who[:-1])
        q, who, score = q[fresh], who[fresh], score[fresh]
        order = np.lexsort((who, -score, q))
        q, who, score = q[order], who[order], score[order]
        take = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return q[take], who[take], score[take]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        for x in a.column("data"):
            shard = _unpack(x.as_py())
            tree = Tree(shard["points"].astype(np.float64), shard["order"], shard["nodes"])
            for y in b.column("data"):
                block = _unpack(y.as_py())
                for i in range(0, len(block["ids"]), STRIDE):
                    asked, queries = block["ids"][i : i + STRIDE], block["vectors"][i : i + STRIDE].astype(np.float64)
                    todo, ask = np.arange(len(queries)), min(k + 1, len(tree.points))
                    while len(todo):
                        q, who, score = near(tree, shard["ids"], shard["members"], shard["starts"], queries[todo], asked[todo], ask)
                        # An id with several vectors takes several of the points; with less than k ids a query asks for more points.
                        done = np.bincount(q, minlength=len(todo)) >= k if ask < len(tree.points) else np.ones(len(todo), bool)
                        take = done[q]
                        for column, values in zip(out, (asked[todo][q[take]], who[take], score[take]), strict=True):
                            column.append(values)
                        todo, ask = todo[~done], min(2 * ask, len(tree.points))
        query, vec, score = (np.concatenate(c) if c else np.zeros(0) for c in out)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
