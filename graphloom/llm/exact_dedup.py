"""Exact deduplication: two Bloom passes, then a shuffle of the possibly repeated rows alone.

Pass one fills, for every slice of the hash space, a Bloom filter whose cells hold 0, 1 or "2 and
more". A hash whose cells all hold "2 and more" is possibly repeated; any other hash is certainly
single. Pass two asks that filter about every row: single rows pass straight through, the others are
grouped by their digest (the largest groups without moving their rows). False positives of the filter are groups of one, so the result is exact.

A filter of up to ``MAX_FILTER_BYTES`` is broadcast. For more rows than that serves, the hash space
has slices of ``SLICE_CELLS`` cells; every slice's full cells are one row, and hashes, these eight bytes
alone, meet those of their slice in a join, all slices in one job. Slices are small, and a slice with a very
frequent hash is split like any skewed join, so no task depends on how large the corpus or a group
is. The possibly repeated hashes that this leaves fill a second filter of ``MAX_FILTER_BYTES``, which
is broadcast and asked about every row: so rows, with whatever texts they carry, stay where they are
unless they may be repeated, at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, checkpointed, fresh, give_back, join_skewed, names_apart, text_or_empty

BITS_PER_ROW = 16
MAX_FILTER_BYTES = 32 << 20
#: Cells that one task of the merge holds.
SEGMENT = 1 << 20
#: Cells of a slice where there is more than one: 2,048 rows' worth.
SLICE_CELLS = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", " ")


def digest(name: str) -> Column:
    return F.sha2(normalised(text_or_empty(name)), 256)


def _cells(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64), (mixed % np.uint64(size)).astype(np.int64)


def _repeated_cells(hashes: DataFrame, size: int, least: int = 2) -> DataFrame:
    """(segment, bitmap of the cells that hold ``least``, one or two, and more), empty bitmaps left out."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _cells(batch.column(0).to_numpy(zero_copy_only=False), size)
            cells, counts = np.unique(np.concatenate([a, b[a != b]]), return_counts=True)
            part = cells // SEGMENT
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            rows = []
            for i, j in zip(starts, [*starts[1:], len(part)], strict=True):
                inside = (cells[i:j] % SEGMENT).astype("<u4")
                rows.append({"part": int(part[i]), "once": inside.tobytes(), "twice": inside[counts[i:j] > 1].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(key: tuple, groups: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.uint8)
        for once, twice in zip(groups.column("once"), groups.column("twice"), strict=True):
            at = np.frombuffer(once.as_py(), "<u4")
            total[at] = np.minimum(total[at] + 1, 2)
            total[np.frombuffer(twice.as_py(), "<u4")] = 2
        bitmap = np.packbits(total >= least).tobytes()
        give_back()
        return pa.table({"part": [key[0].as_py()], "bitmap": pa.array([bitmap], pa.binary())})

    filled = hashes.mapInArrow(fill, "part long, once binary, twice binary")
    return filled.groupBy("part").applyInArrow(merge, "part long, bitmap binary")


def flag_possibly_repeated(keys: DataFrame, hash_col: str, out: str) -> DataFrame:
    """Adds a boolean column: false only where no other row has the hash."""
    total = keys.count()
    largest = MAX_FILTER_BYTES * 8
    if total * BITS_PER_ROW <= largest:
        size, hashes, least = max(1024, total * BITS_PER_ROW), keys.select(hash_col), 2
    else:
        size, hashes, least = largest, _repeated_in_slices(keys.select(F.col(hash_col).alias("h")), total), 1
    known = keys.sparkSession.sparkContext.broadcast({r.part: bytes(r.bitmap) for r in _repeated_cells(hashes, size, least).collect()})
    return keys.withColumn(out, _asker(known, size)(F.col(hash_col)))


def _repeated_in_slices(hashes: DataFrame, total: int) -> DataFrame:
    """The possibly repeated ones of ``total`` hashes h, each once, by filters of which each task holds a slice."""
    slices = -(-total * BITS_PER_ROW // SLICE_CELLS)
    mixed = lambda i, n: F.pmod(F.xxhash64("h", F.lit(i)), F.lit(n))
    placed = hashes.select("h", mixed(1, slices).alias("slice"), mixed(2, SLICE_CELLS).cast("int").alias("a"), mixed(3, SLICE_CELLS).cast("int").alias("b"))
    cells = placed.select("slice", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell")).groupBy("slice", "cell").count().where("count > 1")
    filters = cells.groupBy("slice").agg(F.collect_list("cell").alias("full"))
    return placed.join(filters, "slice").where(F.array_contains("full", F.col("a")) & F.array_contains("full", F.col("b"))).select("h").distinct()


def _asker(known: Broadcast, size: int) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def ask(h):
        import pandas as pd

        hit = np.ones(len(h), bool)
        for cells in _cells(h.to_numpy(), size):
            for s in np.unique(cells // SEGMENT):
                at = cells // SEGMENT == s
                bits = np.frombuffer(known.value.get(int(s)) or bytes(SEGMENT // 8), np.uint8)
                inside = cells[at] % SEGMENT
                hit[at] &= (bits[inside >> 3] >> (7 - (inside & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(hit)

    return ask


def _decided(docs: DataFrame, sha: str, id_col: str, taken: list[str]) -> tuple[DataFrame, DataFrame, tuple[str, str, str]]:
    """(rows whose digest is certainly single, the other rows with their group's decision, the names of the decision).

    A decision: the id that stays, the number of the group's rows, and how many of them have that id.
    """
    h, maybe, keep, size, n_keep = (fresh(x, taken) for x in ("hash", "maybe", "keep_id", "group_size", "n_keep"))
    flagged = flag_possibly_repeated(docs.withColumn(h, F.xxhash64(sha)), h, maybe).drop(h)
    again = flagged.where(F.col(maybe)).drop(maybe)
    per_id = again.groupBy(sha, id_col).agg(F.count("*").alias("c"))
    groups = per_id.groupBy(sha).agg(F.min(id_col).alias(keep), F.sum("c").alias(size), F.coalesce(F.min_by("c", id_col), F.sum("c")).alias(n_keep))
    return flagged.where(~F.col(maybe)).drop(maybe), join_skewed(again, groups, sha, size), (keep, size, n_keep)


@names_apart("keep_id", "group_size", "kept", "text_sha256")
def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts the one with the smallest id stays; of rows that also share
    that id, one. A null text counts as empty. A null id is never the smallest unless all ids of its
    group are null; then one of those rows stays. An empty table gives an empty result.
    """
    sha = fresh("text_sha256", docs.columns)
    keyed = checkpointed(docs.select(id_col, digest(text_col).alias(sha)))
    single, met, (keep, size, n_keep) = _decided(keyed, sha, id_col, docs.columns)
    alone = single.select(id_col, F.col(id_col).alias(keep), F.lit(1).cast("long").alias(size), F.lit(True).alias("kept"), sha)
    first = F.col(id_col).eqNullSafe(F.col(keep))
    clear = met.where(~first | (F.col(n_keep) == 1)).select(id_col, keep, size, first.alias("kept"), sha)
    # Rows that share the id that stays are alike in all columns: they are counted and written out again, the first of them as kept.
    alike = met.where(first & (F.col(n_keep) > 1)).groupBy(sha, id_col, keep, size).agg(F.count("*").alias("copies"))
    unclear = alike.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")).select(id_col, keep, size, (F.col("nth") == 1).alias("kept"), sha)
    return alone.unionByName(clear).unionByName(unclear).withColumnsRenamed({keep: "keep_id", size: "group_size", sha: "text_sha256"})


def keep_first_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their own columns only; which as in exact_dedup.

    Of rows that share text and id, any one stays, whole. Only rows whose text may be repeated move.
    """
    inside = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(inside)
    key, names = inside[id_col], tuple(inside.values())
    keyed = plain.withColumn("sha", digest(inside[text_col]))
    single, met, (keep, _, n_keep) = _decided(keyed, "sha", key, keyed.columns)
    first = met.where(F.col(key).eqNullSafe(F.col(keep)))
    clear = first.where(F.col(n_keep) == 1).select(*names)
    one = first.where(F.col(n_keep) > 1).dropDuplicates(["sha"]).select(*names)
    return single.select(*names).unionByName(clear).unionByName(one).select(*(F.col(v).alias(k) for k, v in inside.items()))
