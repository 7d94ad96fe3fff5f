"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has bit b where bit b is set in over half of its shingles' hashes. Distinct
fingerprints are sorted into tiles by the population counts of their four 16-bit parts. The counts
of two fingerprints differ part by part by no more, in sum, than their bits do, so two tiles whose
counts differ beyond the radius are skipped; the others are compared with exclusive-or and bit
counts, all against all. Nothing is approximated.

Tiles hold at most ``TILE`` fingerprints; larger ones are split into chunks. The pairs of chunks to
compare are made as pairs of keys, which are dealt out by their second chunk before any chunk's
fingerprints are fetched: so the commonest tile is as many tasks' work as it has chunks. A comparison hands on a spanning forest of what it linked, never all
pairs. Components come from rounds of star contraction over those links, every round in the shared
folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from .common import checkpointed, fresh, give_back, join_skewed, names_apart, small_batches

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 2048
PARTS = 4
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Marks of 16 bytes that go to every task at most.
MANY = 500_000
#: Shingles whose bits are added up at a time.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = SHINGLE) -> int:
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, carry: dict[str, Column], words: int = SHINGLE) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long."""

    small_batches(docs)
    names = [*carry, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(0)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=names)
        give_back()

    rows = docs.select(F.col(text_col).alias("t"), *(c.alias(k) for k, c in carry.items()))
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "fp long"]))


def _counts(fps: np.ndarray) -> np.ndarray:
    """The population counts of the parts of each fingerprint, one base-32 digit a part."""
    parts = np.bitwise_count(fps.astype(np.int64).view(np.uint16).reshape(-1, PARTS)).astype(np.int64)
    return parts @ (32 ** np.arange(PARTS))


def _offsets(radius: int) -> list[int]:
    """Differences of tile keys to look at, each pair of tiles from one side only."""
    steps = itertools.product(range(-radius, radius + 1), repeat=PARTS)
    keys = [sum(d * 32**i for i, d in enumerate(s)) for s in steps if sum(map(abs, s)) <= radius]
    return sorted(k for k in keys if k >= 0)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b, one from each linked value to the smallest one of its component."""
    values, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(values))
    return values[far], values[label[far]]


def _close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of x and y within the radius, found in blocks of rows; handed on as a forest."""
    left, right = [], []
    for i in range(0, len(x), 256):
        p, q = np.nonzero(np.bitwise_count(x[i : i + 256, None] ^ y[None, :]) <= radius)
        keep = x[i + p] != y[q]
        if keep.any():
            a, b = _forest(x[i + p[keep]].view(np.int64), y[q[keep]].view(np.int64))
            left.append(a)
            right.append(b)
    if not left:
        none = np.zeros(0, np.int64)
        return none, none
    return _forest(np.concatenate(left), np.concatenate(right))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest over each comparison's pairs within the radius.

    distinct has one row for each fingerprint, in column fp.
    """

    @F.pandas_udf("long")
    def tile_key(fp):
        import pandas as pd

        return pd.Series(_counts(fp.to_numpy()))

    def blob(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"tile": [key[0].as_py()], "chunk": [key[1].as_py()], "fps": pa.array([np.sort(rows.column("fp").to_numpy()).astype("<i8").tobytes()], pa.binary())})

    keyed = distinct.select("fp", tile_key("fp").alias("tile"))
    sizes = keyed.groupBy("tile").count().select("tile", F.ceil(F.col("count") / TILE).cast("long").alias("chunks"))
    dealt = keyed.join(sizes, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), "fp")
    tiles = checkpointed(dealt.groupBy("tile", "chunk").applyInArrow(blob, "tile long, chunk long, fps binary"))
    steps = F.array(*(F.lit(k).cast("long") for k in _offsets(radius)))
    keys = tiles.select("tile", "chunk")
    asks = keys.select(F.col("tile").alias("tile_x"), F.col("chunk").alias("chunk_x"), F.explode(steps).alias("step")).withColumn("tile", F.col("tile_x") + F.col("step"))
    pairs = asks.join(keys, "tile").where("step > 0 or chunk_x <= chunk").drop("step")
    first = pairs.join(tiles.select(F.col("tile").alias("tile_x"), F.col("chunk").alias("chunk_x"), F.col("fps").alias("x")), ["tile_x", "chunk_x"])
    both = first.join(tiles.hint("shuffle_hash"), ["tile", "chunk"]).select("x", F.col("fps").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = _close(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) between different nodes: root is the smallest node reachable."""
    return star_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), []).withColumnRenamed("comp", "root")


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for the fingerprints that are linked to others."""
    return components(links(rows.select("fp").distinct(), radius))


@names_apart("fingerprint", "component_id")
def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the
    own id included. Null and empty texts have fingerprint zero and link like any other; a text with
    fewer words than a shingle has one shingle. Null ids are never smallest, unless a component has no other.
    """
    rows = checkpointed(fingerprints(docs, text_col, {"id": F.col(id_col)}, words))
    smallest = rows.groupBy("fp").agg(F.min("id").alias("own"), F.count("*").alias("copies"))
    known = smallest.join(_grouped(rows, radius).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = known.groupBy("root").agg(F.min("own").alias("component_id"))
    mapped = known.join(tops, "root").select("fp", "component_id", "copies")
    return join_skewed(rows, mapped, "fp", "copies").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, with their own columns only.

    The smallest id stays; of rows that share it, any one. Rows with null ids stay only in components without ids.
    """
    inside = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(inside)
    text, key = inside[text_col], inside[id_col]
    mark = F.unhex(F.md5(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}).cast("binary")))
    rows = checkpointed(fingerprints(plain.withColumn("mark", mark), text, {"id": F.col(key), "mark": F.col("mark")}, words))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))).alias("own"), F.count("*").alias("copies"))
    known = first.join(_grouped(rows, radius).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = known.groupBy("root").agg(F.min("own").alias("own")).select("root", F.col("own.mark").alias("kept"))
    decided = join_skewed(rows.select("fp", "mark"), known.select("fp", "root", "copies").join(kept, "root").select("fp", "kept", "copies"), "fp", "copies")
    gone = checkpointed(decided.where("mark <> kept").select("mark").distinct())
    # Rows that repeat in all columns share a mark: of those that stay, one does.
    alike = checkpointed(decided.where("mark = kept").groupBy("mark").count().where("count > 1").select("mark"))
    stay = plain.withColumn("mark", mark).join(_sized(gone), "mark", "left_anti")
    one = stay.join(_sized(alike), "mark", "left_semi").dropDuplicates(["mark"])
    return stay.join(_sized(alike), "mark", "left_anti").unionByName(one).select(*(F.col(v).alias(k) for k, v in inside.items()))


def _sized(marks: DataFrame) -> DataFrame:
    """Marks to join with: to every task if they are ``MANY`` at most, by a shuffle otherwise."""
    return F.broadcast(marks) if marks.count() <= MANY else marks.hint("merge")
