"""Alignment, localisation and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.triples import serialize
from .lineage import checkpointed


def positional_zip(left: DataFrame, right: DataFrame, index: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides at the same position; a missing partner or a differing column of ``same`` is an error.

    Columns of the right side get the prefix r_.
    """
    a = left.withColumn("in_left", F.lit(True))
    b = right.select(F.col(index).alias("r_index"), F.lit(True).alias("in_right"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != index))
    both = a.join(b, F.col(index) == F.col("r_index"), "full_outer")
    wrong = F.col("in_left").isNull() | F.col("in_right").isNull()
    message = F.concat(F.lit("no partner at position "), F.coalesce(F.col(index), F.col("r_index")).cast("string"))
    for c in same:
        clash = F.col(c).isNotNull() & F.col(f"r_{c}").isNotNull() & (F.col(c) != F.col(f"r_{c}"))
        message = F.when(clash, F.concat(F.lit(f"{c} differs at position "), F.col(index).cast("string"))).otherwise(message)
        wrong = wrong | clash
    checked = F.when(wrong, F.raise_error(message)).otherwise(F.col(index))
    return both.withColumn(index, checked).drop("in_left", "in_right", "r_index")


def zip_status(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """How two numbered sides match: (status, n) for both, left_only and right_only."""
    a, b = left.select(F.col(index).alias("i"), F.lit(True).alias("a")), right.select(F.col(index).alias("i"), F.lit(True).alias("b"))
    status = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    return a.join(b, "i", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def localize(doc: DataFrame, whole: DataFrame, rec: str = "rec") -> DataFrame:
    """Triples of documents that are in the record's global set, distinct per document, first position kept."""
    mine = doc.groupBy(rec, "ctx_pos", "h", "r", "t").agg(F.min("t_pos").alias("t_pos"))
    return mine.join(whole.select(rec, "h", "r", "t").distinct(), [rec, "h", "r", "t"], "left_semi")


def localized_lists(doc: DataFrame, whole: DataFrame, rec: str = "rec", family: str = "neutral") -> DataFrame:
    """One array of tagged strings per document, in extraction order."""
    rows = localize(doc, whole, rec)
    item = F.struct("t_pos", serialize(F.struct("h", "r", "t"), family).alias("s"))
    return rows.groupBy(rec, "ctx_pos").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("items"))


def require_all(rows: DataFrame, known: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows; any whose keys are unknown is an error."""
    marked = rows.join(known.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    first = keys[0]
    return marked.withColumn(first, F.when(F.col("known").isNull(), F.raise_error(F.concat_ws(" ", F.lit(what), *(F.col(k).cast("string") for k in keys)))).otherwise(F.col(first))).drop("known")


def edge_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side whose edge is not on the right; repeats on the left stay."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


#: Pairs that a task makes.
PAIRS = 4_000_000


def qa_pairs(entities: DataFrame, answers: DataFrame, rec: str = "rec", pairs: int = PAIRS) -> DataFrame:
    """All (entity, answer) pairs of each record; empty strings form none.

    A record with many of both has more pairs than a task should make. They are cut into cells of about ``pairs``, each
    one task's work: entities are dealt out by hash among rows of cells, answers among columns, repeats one by one. A cell
    holds its answers, about the root of ``pairs`` at most, as one array that each of its entities unfolds.
    """
    sides = entities.where("entity <> ''").select(rec, "entity"), answers.where("answer <> ''").select(rec, "answer")
    counts = [x.groupBy(rec).agg(F.count("*").alias(c)) for x, c in zip(sides, ("a", "b"), strict=True)]
    sizes = counts[0].join(counts[1], rec).withColumn("columns", F.ceil(F.col("b") / math.isqrt(pairs)))
    rows = F.ceil(F.col("a") * F.ceil(F.col("b") / F.col("columns")) / pairs)
    sizes = checkpointed(sizes.select(rec, "columns", rows.alias("rows"), (F.col("a") * F.col("b")).alias("n")))
    tasks = max(entities.sparkSession.sparkContext.defaultParallelism, (sizes.agg(F.sum("n")).first()[0] or 0) // pairs + 1)
    cell = [rec, "row", "column"]

    def dealt(side: DataFrame, name: str, places: str, place: str) -> DataFrame:
        """Each row at its place: a value's first, second and later ones at places of their own."""
        nth = F.row_number().over(Window.partitionBy(rec, name).orderBy(F.lit(0)))
        return side.withColumn("nth", nth).join(sizes, rec).withColumn(place, F.pmod(F.xxhash64(name, "nth"), places))

    def all_of(places: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(places) - 1))

    asked = dealt(sides[0], "entity", "rows", "row").select(rec, "row", all_of("columns").alias("column"), "entity")
    held = dealt(sides[1], "answer", "columns", "column").groupBy(rec, "rows", "column").agg(F.collect_list("answer").alias("answers"))
    held = held.select(rec, all_of("rows").alias("row"), "column", "answers")
    return asked.repartition(tasks, *cell).join(held.repartition(tasks, *cell).hint("shuffle_hash"), cell).select(rec, "entity", F.explode("answers").alias("answer"))


def names_match(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def relation_tail_conflicts(public: DataFrame, private: DataFrame, rec: str = "rec") -> DataFrame:
    """Public triples with a private one of equal relation and tail whose head is alike.

    A hash join by relation and tail; the heads are compared as its residual condition.
    """
    p = private.select(F.col(rec).alias("p_rec"), F.col("r").alias("p_r"), F.col("t").alias("p_t"), F.col("h").alias("p_h")).distinct()
    same = (F.col(rec) == F.col("p_rec")) & (F.col("r") == F.col("p_r")) & (F.col("t") == F.col("p_t")) & names_match(F.col("h"), F.col("p_h"))
    return public.join(p, same, "left_semi")


def merge_steps(reward: DataFrame, update: DataFrame, step: str = "step") -> DataFrame:
    """Reward and update rows of the same step; steps on one side only, or repeated, are errors."""
    a, b = (x.groupBy(step).agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in x.columns if c != step)) for x in (reward, update))
    both = a.withColumnRenamed("k", "ka").join(b.withColumnRenamed("k", "kb"), step, "full_outer")
    bad = F.coalesce(F.col("ka"), F.lit(0)) + F.coalesce(F.col("kb"), F.lit(0)) != 2
    bad = bad | F.col("ka").isNull() | F.col("kb").isNull()
    return both.withColumn(step, F.when(bad, F.raise_error(F.concat(F.lit("step without exactly one reward and one update row: "), F.col(step).cast("string")))).otherwise(F.col(step))).drop("ka", "kb")


def not_in_global(local: Column, whole: Column) -> Column:
    """How many different local items the global collection lacks."""
    return F.size(F.array_except(local, whole))


def mismatch_rows(predicted: DataFrame, reference: DataFrame, keys: list[str], scope: str = "rec") -> DataFrame:
    """(scope, kind, keys): what each scope lacks of the reference (missing) and has beyond it (extra), one row each.

    One aggregation over both sides; a sink sorts the rows.
    """
    sides = predicted.select(scope, *keys, F.lit("extra").alias("kind")).unionByName(reference.select(scope, *keys, F.lit("missing").alias("kind")))
    return sides.groupBy(scope, *keys).agg(F.min("kind").alias("kind"), F.max("kind").alias("_other")).where(F.col("kind") == F.col("_other")).select(scope, "kind", *keys)


def reuse_status(source: DataFrame, output: DataFrame, index: str) -> DataFrame:
    """(index, status): whether records that were written before still fit their source.

    Both sides have the index, id and ctxs as VARIANT lists of contexts: ok, no_partner, other_id, no_list,
    other_count, or bad_text where an output context is no object with a string as its text.
    """
    out = output.select(F.col(index).alias("_index"), F.col("id").alias("_id"), F.col("ctxs").alias("_ctxs"))
    both = source.select(index, "id", "ctxs").join(out, F.col(index) == F.col("_index"), "full_outer")
    items = lambda c: F.try_variant_get(c, "$", "array<variant>")
    text = lambda v: F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING"
    status = (
        F.when(F.col(index).isNull() | F.col("_index").isNull(), "no_partner")
        .when(~F.col("id").eqNullSafe(F.col("_id")), "other_id")
        .when(items("ctxs").isNull() | items("_ctxs").isNull(), "no_list")
        .when(F.size(items("ctxs")) != F.size(items("_ctxs")), "other_count")
        .when(~F.coalesce(F.forall(items("_ctxs"), lambda v: F.coalesce(text(v), F.lit(False))), F.lit(False)), "bad_text")
        .otherwise("ok")
    )
    return both.select(F.coalesce(index, "_index").alias(index), status.alias("status"))


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """In how many keys two tables overlap."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("n"))


def set_sizes(predicted: DataFrame, reference: DataFrame, keys: list[str], scope: str = "rec") -> DataFrame:
    """Per scope the sizes of intersection, union, both differences, and whether they overlap or one holds the other.

    One aggregation over the union of both sides, no join.
    """
    rows = predicted.select(scope, *keys, F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(reference.select(scope, *keys, F.lit(0).alias("p"), F.lit(1).alias("q")))
    each = rows.groupBy(scope, *keys).agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return each.groupBy(scope).agg(
        F.sum(F.col("p") * F.col("q")).alias("both"),
        F.count("*").alias("either"),
        F.sum(F.col("p") * (1 - F.col("q"))).alias("extra"),
        F.sum((1 - F.col("p")) * F.col("q")).alias("missing"),
    ).withColumns({"overlap": F.col("both") > 0, "covers": F.col("missing") == 0})
