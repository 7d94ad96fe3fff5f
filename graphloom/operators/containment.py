"""Which names hold which others, by an index of q-grams instead of all pairs.

A name that another one holds has all its q-grams there. So the rarest q-gram of the shorter name
is looked up among those of the longer ones, inside of the scope that both belong to, and what is
found is verified, once for each pair of distinct names. Names shorter than a q-gram are looked up
whole, among grams of their own length, which are made only in scopes that ask for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(name: Column, size: Column) -> Column:
    """The distinct grams of a size (an empty one for size 0); none of a shorter name."""
    starts = F.when(size == 0, F.array(F.lit(1))).when(F.char_length(name) >= size, F.sequence(F.lit(1), F.char_length(name) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(name, i, size)))


def contained(short: DataFrame, long: DataFrame, keys: list[str], gram: int = GRAM) -> DataFrame:
    """(keys, short, long): the names of ``short`` that a longer name of ``long`` holds, each pair once; equal names are none.

    Both sides have the keys of a scope, which are not null, and a name; null names are left out.
    """
    mine = short.select(*keys, F.col("name").alias("short")).where("short is not null").distinct()
    whole = long.select(*keys, F.col("name").alias("long")).where("long is not null").distinct()
    size = F.least(F.char_length("short"), F.lit(gram))
    asked = mine.select(*keys, size.alias("size")).distinct()
    held = whole.join(asked, keys).select(*keys, "long", F.explode(_grams(F.col("long"), F.col("size"))).alias("gram"))
    known = held.groupBy(*keys, "gram").agg(F.count("*").alias("df"))
    grams = mine.select(*keys, "short", _grams(F.col("short"), size).alias("all")).select(*keys, "short", F.size("all").alias("n"), F.explode("all").alias("gram"))
    rarest = grams.join(known, [*keys, "gram"]).groupBy(*keys, "short", "n").agg(F.count("*").alias("found"), F.min(F.struct("df", "gram")).alias("least"))
    probes = rarest.where("found = n").select(*keys, "short", F.col("least.gram").alias("gram"))
    return probes.join(held, [*keys, "gram"]).where(F.contains("long", "short") & (F.char_length("long") > F.char_length("short"))).select(*keys, "short", "long")


def alike_names(goals: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, goal, node): equal names, and those of which one holds the other."""
    same = goals.select(*keys, "name").distinct().join(nodes.select(*keys, "name").distinct(), [*keys, "name"])
    inside = contained(goals, nodes, keys).select(*keys, F.col("short").alias("goal"), F.col("long").alias("node"))
    around = contained(nodes, goals, keys).select(*keys, F.col("long").alias("goal"), F.col("short").alias("node"))
    return same.select(*keys, F.col("name").alias("goal"), F.col("name").alias("node")).unionByName(inside).unionByName(around)
