"""Order-dependent deduplication over the long table triples(rec, ctx_pos, t_pos, h, r, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_status(triples: DataFrame, rec: str = "rec", order: tuple[str, ...] = ("ctx_pos", "t_pos"), inside: bool = False) -> DataFrame:
    """Adds status: substring, kept, duplicate or collision, and with ``inside`` whether the tail is inside its head.

    A tail inside its head is dropped. Per record, head and relation the first tail stays; equal
    ones after it are duplicates, others collisions.
    """
    w = Window.partitionBy(rec, "h", "r", "inside").orderBy(*order)
    ranked = triples.withColumn("inside", F.contains("h", "t")).withColumn("n", F.row_number().over(w)).withColumn("first_t", F.first("t").over(w))
    status = F.when(F.col("inside"), "substring").when(F.col("n") == 1, "kept").when(F.col("t") == F.col("first_t"), "duplicate").otherwise("collision")
    return ranked.withColumn("status", status).drop("n", "first_t", *(() if inside else ("inside",)))


def merge_global(triples: DataFrame, rec: str = "rec") -> DataFrame:
    """The global graph of each record."""
    return with_status(triples, rec).where("status = 'kept'").drop("status")


def merge_counters(triples: DataFrame, rec: str = "rec") -> DataFrame:
    kinds = ("kept", "duplicate", "collision", "substring")
    return with_status(triples, rec).groupBy(rec).agg(F.count("*").alias("seen"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def no_self_loops(triples: DataFrame) -> DataFrame:
    return triples.where("h is not null and r is not null and t is not null and h <> t")


def first_per_pair(triples: DataFrame, scope: tuple[str, ...] = ("rec",), order: tuple[str, ...] = ("ctx_pos", "t_pos")) -> DataFrame:
    """Self-loops go; of triples between the same two entities, either way, the first stays."""
    pair = (F.least("h", "t"), F.greatest("h", "t"))
    w = Window.partitionBy(*scope, *pair).orderBy(*order)
    return no_self_loops(triples).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def pair_counters(triples: DataFrame, scope: tuple[str, ...] = ("rec",)) -> DataFrame:
    """raw, kept, self-loops, exact duplicates and other repeats of a pair.

    Counted from triples to pairs to scopes, so rows that lie by scope are not moved again.
    """
    real = F.col("h") != F.col("t")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    different = triples.groupBy(*scope, "h", "r", "t").agg(F.count("*").alias("n"))
    pairs = different.groupBy(*scope, F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"), real.alias("real")).agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    out = pairs.groupBy(*scope).agg(some("n").alias("raw"), some(F.when(~F.col("real"), F.col("n"))).alias("self_loops"), some(F.when(F.col("real"), F.col("different"))).alias("different"), F.count_if("real").alias("kept"))
    return out.select(*scope, "raw", "self_loops", (F.col("raw") - F.col("self_loops") - F.col("different")).alias("duplicates"), (F.col("different") - F.col("kept")).alias("pair_repeats"), "kept")


def distinct_triples(triples: DataFrame, scope: tuple[str, ...] = ("rec",)) -> DataFrame:
    return triples.select(*scope, "h", "r", "t").distinct()


def distinct_edges(triples: DataFrame, scope: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Oriented entity pairs, whatever the relation, without self-loops."""
    return no_self_loops(triples).select(*scope, "h", "t").distinct()


def smallest_per_key(rows: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    """One row per key, the one with the smallest order; partial aggregation, no window."""
    best = F.struct(*order, *(c for c in rows.columns if c not in order))
    return rows.groupBy(key.alias("key")).agg(F.min(best).alias("row")).select("key", "row.*")
