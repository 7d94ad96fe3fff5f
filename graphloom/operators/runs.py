"""Runs of equal neighbours (gaps and islands) and checks of numbered sequences.

A global order needs no single task: rows are range-partitioned by the order, each partition is
numbered on its own, and the partitions' totals (one row each) are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def global_lag_and_sum(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds starts (the value differs from the row before) and run (the running sum of starts).

    ``order`` is unique. There are as many ranges as the session has shuffle partitions, so their size
    is the session's choice as for any sort. What crosses a partition's edge is its last value and its number of starts:
    one row a partition, the only rows that meet in one window.
    """
    parted = checkpointed(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(order)
    marked = parted.withColumn("before", F.lag(value).over(w)).withColumn("n", F.row_number().over(w))
    edges = parted.groupBy("part").agg(F.max_by(value, order).alias("last_value"), F.max(order).alias("last_order"))
    previous = edges.withColumn("carry", F.lag("last_value").over(Window.orderBy("last_order"))).withColumn("first_part", F.row_number().over(Window.orderBy("last_order")) == 1).select("part", "carry", "first_part")
    joined = marked.join(previous, "part").withColumn("starts", F.when(F.col("n") > 1, ~F.col("before").eqNullSafe(F.col(value))).otherwise(F.col("first_part") | ~F.col("carry").eqNullSafe(F.col(value))))
    local = joined.withColumn("local_run", F.sum(F.col("starts").cast("long")).over(w))
    totals = joined.groupBy("part").agg(F.sum(F.col("starts").cast("long")).alias("k"), F.max(order).alias("last_order"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("k").over(Window.orderBy("last_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "offset")
    return local.join(offsets, "part").withColumn("run", F.col("local_run") + F.col("offset")).drop("part", "before", "n", "carry", "first_part", "local_run", "offset")


def run_groups(rows: DataFrame, order: str, value: str) -> DataFrame:
    """One row per run: run, value, first, last, size and recurrence (the value had a run before)."""
    runs = global_lag_and_sum(rows, order, value).groupBy("run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    nth = F.row_number().over(Window.partitionBy(value).orderBy("run"))
    return runs.withColumn("recurrence", nth > 1)


def run_stats(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Runs, largest run, values, and values that come back after another."""
    per = run_groups(rows, order, value).groupBy(value).agg(F.count("*").alias("k"), F.max("size").alias("largest"))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("segments"), F.max("largest").alias("max_segment"), F.count("*").alias("unique_values"), F.count_if(F.col("k") > 1).alias("non_contiguous"))


def contiguity(rows: DataFrame, scope: str, step: str) -> DataFrame:
    """Whether the steps of each scope are 1..N, each once."""
    return rows.groupBy(scope).agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count(step).alias("n"), F.count_distinct(step).alias("d")).withColumn("contiguous", (F.col("first") == 1) & (F.col("last") == F.col("d")) & (F.col("n") == F.col("d")))


def repeated_ids(rows: DataFrame, scope: str, key: str) -> DataFrame:
    """Ids that occur more than once in their record."""
    return rows.groupBy(scope, key).agg(F.count("*").alias("n")).where("n > 1")


def regroup(rows: DataFrame, order: str, value: str, most_groups: int | None = None, most_docs: int | None = None) -> DataFrame:
    """Numbers runs as groups: rows with group and place (both from 0) inside of both caps.

    Groups are the runs of equal values in row order; a cap on groups keeps the first ones, a cap on
    documents the first of each group.
    """
    marked = global_lag_and_sum(rows, order, value).withColumn("group", F.col("run") - 1).drop("starts", "run")
    if most_groups is not None:
        marked = marked.where(F.col("group") < most_groups)
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(order)) - 1)
    return placed if most_docs is None else placed.where(F.col("place") < most_docs)


def regroup_counts(rows: DataFrame, order: str, value: str, most_docs: int) -> DataFrame:
    """Groups, documents inside and outside of the cap, and runs whose value had one before."""
    runs = run_groups(rows, order, value)
    return runs.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.least("size", F.lit(most_docs))), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.greatest(F.col("size") - most_docs, F.lit(0))), F.lit(0)).alias("skipped"),
        F.count_if("recurrence").alias("repeated_groups"),
    )
