"""Deterministic selection, splits and samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import priority
from ..functions.triples import NO_SPACE, question_key
from .dedup import smallest_per_key
from .lineage import checkpointed


def _keyed(rows: DataFrame, question: str, index: str) -> DataFrame:
    """(idx, k, mark) of all rows that have a key; mark stands for the key where keys are compared, so no text is moved."""
    # A key is empty where the question holds nothing but white space; asking the key itself would fold the text twice.
    keyed = rows.where(F.regexp_like(question, F.lit(NO_SPACE))).select(F.col(index).alias("idx"), question_key(F.col(question)).alias("k"))
    return keyed.withColumn("mark", F.sha2("k", 256))


def ranked_unique(rows: DataFrame, question: str, index: str, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """One row per question key: mark (the sha256 of the key), priority, index. ``exclude`` has a column key."""
    scored = _keyed(rows, question, index).select("mark", priority(seed, F.col("k"), F.col("idx")).alias("priority"), F.col("idx").alias("index"))
    if exclude is not None:
        scored = scored.join(exclude.select(F.sha2("key", 256).alias("mark")), "mark", "left_anti")
    return smallest_per_key(scored, F.col("mark"), ("priority", "index")).select(F.col("key").alias("mark"), "priority", "index")


def select_unique(rows: DataFrame, question: str, index: str, n: int, seed: int = 42, exclude: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The n unique questions of smallest priority, with their rank from 1; fewer is an error if ``strict``.

    A top-n by order and limit: each task keeps n rows, no global sort. The keys of the n are made anew from their
    rows, so texts stay where they are.
    """
    top = checkpointed(ranked_unique(rows, question, index, seed, exclude).orderBy("priority", "index", "mark").limit(n))
    named = rows.select(question, index).join(top.select(F.col("index").alias("of")).distinct(), F.col(index).eqNullSafe(F.col("of")), "left_semi")
    keys = _keyed(named, question, index).groupBy(F.col("mark").alias("own")).agg(F.first("k").alias("key"))
    # Null-safe, as Spark else asks every row's key whether it is null, ahead of the join that leaves n rows.
    ranked = top.join(keys, F.col("mark").eqNullSafe(F.col("own"))).withColumn("rank", F.row_number().over(Window.orderBy("priority", "index", "key"))).select("key", "priority", "index", "rank")
    if strict and (found := top.count()) < n:
        raise ValueError(f"{n} unique questions are asked for, {found} exist")
    return ranked


def train_eval_split(ranked: DataFrame, train: int) -> DataFrame:
    """Slices one ranked list."""
    return ranked.withColumn("split", F.when(F.col("rank") <= train, "train").otherwise("eval"))


def exclude_keys(rows: DataFrame, question: str, other: DataFrame, other_question: str) -> DataFrame:
    """Rows whose question is not among the other table's."""
    used = other.select(question_key(F.col(other_question)).alias("k"))
    return rows.withColumn("k", question_key(F.col(question))).join(used, "k", "left_anti").drop("k")


def floor_share(n: Column, rate: float) -> Column:
    return F.floor(n * F.lit(float(rate))).cast("int")


def hash_sample(rows: DataFrame, scope: str, key: Column, rate: float, order: Column) -> DataFrame:
    """Of each scope the floor(n * rate) rows with the smallest sha256 of the key, and a flag on all rows."""
    w = Window.partitionBy(scope)
    return rows.withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.sha2(key, 256), order))).withColumn("sampled", F.col("nth") <= floor_share(F.col("n"), rate)).drop("n", "nth")


def seeded_indices(n: int, k: int, seed: int = 42) -> list[int]:
    """The positions that random.sample draws, in drawn order."""
    return random.Random(seed).sample(range(n), min(k, n))


def seeded_sample(rows: DataFrame, index: str, total: int, k: int, seed: int = 42, keep_order: bool = False) -> DataFrame:
    """Rows at the drawn positions, in row order, or with ``keep_order`` by draw.

    The draw is k numbers on the driver, k being the size of the sample that is asked for.
    """
    spark = rows.sparkSession
    drawn = spark.createDataFrame([(i, d) for d, i in enumerate(seeded_indices(total, k, seed))], "pos long, draw int")
    found = rows.join(drawn, rows[index] == drawn["pos"]).drop("pos")
    return found.orderBy("draw") if keep_order else found.orderBy(index).drop("draw")


def shared_samples(sizes: list[int], share: float, seed: int = 42, most: int | None = None) -> list[list[int]]:
    """For files of these sizes the positions drawn in order by one generator that all files share.

    A share of one takes a file as it is and draws nothing; ``most`` ends the whole list.
    """
    drawn, generator, left = [], random.Random(seed), most
    for n in sizes:
        picked = list(range(n)) if share == 1.0 else generator.sample(range(n), int(n * share))
        if left is not None:
            picked, left = picked[:left], max(left - len(picked), 0)
        drawn.append(picked)
    return drawn


def first_contexts(ctxs: DataFrame, k: int, rec: str = "rec", pos: str = "ctx_pos", key: str = "ctx_id") -> DataFrame:
    """The first k contexts of each record that have an id."""
    nth = F.count(key).over(Window.partitionBy(rec).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return ctxs.withColumn("nth", nth).where(F.col(key).isNotNull() & (F.col("nth") <= k)).drop("nth")


def shards(rows: DataFrame, index: str, size: int) -> DataFrame:
    """(shard, start, count) of equal pieces of a numbered table."""
    return rows.groupBy(F.floor(F.col(index) / size).cast("long").alias("shard")).agg(F.min(index).alias("start"), F.count("*").alias("count"))


def hash_split(rows: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """A random split by hash: split is validation for about ``share`` of the keys, and of two keys or more at least one a side.

    The smallest hash is always validation, the largest train; one key alone is train. Only the two extremes meet the rows.
    """
    marked = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256))
    ends = marked.agg(F.min("_h").alias("_first"), F.max("_h").alias("_last"))
    below = F.substring("_h", 1, 8) < f"{int(share * 16**8):08x}"
    return marked.crossJoin(F.broadcast(ends)).withColumn("split", F.when((F.col("_h") < F.col("_last")) & ((F.col("_h") == F.col("_first")) | below), "validation").otherwise("train")).drop("_h", "_first", "_last")


def chunks(rows: DataFrame, index: str, size: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col(index) / size).cast("long"))


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)
