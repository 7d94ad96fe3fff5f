"""The chain from retrieved records to metrics, as one lazy plan with a cut after the splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedup, evalsets, joins, metrics, models, selection, split
from ..operators.lineage import checkpointed


@dataclass
class Prepared:
    """Triples of documents (local), and private and public triples of records."""

    local: DataFrame
    private: DataFrame
    public: DataFrame
    stats: DataFrame


def contexts_of(records: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, ctx_pos, ctx_id, text) of records with ctxs."""
    return records.select(rec, F.posexplode("ctxs").alias("ctx_pos", "c")).select(rec, "ctx_pos", F.col("c.id").cast("string").alias("ctx_id"), F.col("c.text").alias("text"))


def prepare(records: DataFrame, extractor: Callable[[], models.Extractor] = models.rule_extractor, resolver: Callable[[], models.Rewriter] = models.identity_resolver, rate: float = 0.25, seed: int = 42) -> Prepared:
    """Resolve, extract, deduplicate, merge, split and localize.

    records: rec, question, answers, ctxs<id, title, text>. Triples are drawn by hash; the entities of
    the question and the answers protect the paths between them.
    """
    ctxs = models.resolve(contexts_of(records), "text", resolver).drop("timed_out")
    found = checkpointed(models.extract(ctxs, "text", ["rec", "ctx_pos"], extractor))
    local = dedup.first_per_pair(found, ("rec", "ctx_pos"), ("t_pos",))
    merged = dedup.merge_global(local).withColumn("pos", F.row_number().over(Window.partitionBy("rec").orderBy("ctx_pos", "t_pos")) - 1)
    key = F.concat_ws("|", F.lit(str(seed)), F.col("rec").cast("string"), F.col("pos").cast("string"))
    drawn = selection.hash_sample(merged, "rec", key, rate, F.col("pos"))
    entities = records.select("rec", F.explode(models.entities(F.col("question"))).alias("entity"))
    checks = joins.qa_pairs(entities, records.select("rec", F.explode("answers").alias("answer")))
    parts = checkpointed(split.split_graph(drawn, checks, rate, seed))
    pick = lambda p: parts.where(F.col("part") == p).select("rec", "pos", "h", "r", "t")
    stats = parts.groupBy("rec").agg(*(F.max(s).alias(s) for s in split.STATS))
    return Prepared(local, pick("private"), pick("public"), stats)


def rl_records(records: DataFrame, done: Prepared) -> DataFrame:
    """Records with global triples, and tagged local triples in each context."""
    lists = {n: joins.localized_lists(done.local, df).withColumnRenamed("items", n) for n, df in (("public", done.public), ("private", done.private))}
    none = F.array().cast("array<string>")
    ctxs = contexts_of(records).join(lists["public"], ["rec", "ctx_pos"], "left").join(lists["private"], ["rec", "ctx_pos"], "left")
    item = F.struct("ctx_pos", F.struct(F.col("ctx_id").alias("id"), "text", F.coalesce("public", none).alias("public"), F.coalesce("private", none).alias("private")).alias("c"))
    packed = ctxs.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("ctxs"))
    whole = lambda df, n: df.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h", "r", "t"))), lambda x: F.array(x["h"], x["r"], x["t"])).alias(n))
    empty = F.array().cast("array<array<string>>")
    out = records.drop("ctxs").join(packed, "rec").join(whole(done.public, "public"), "rec", "left").join(whole(done.private, "privacy"), "rec", "left")
    return out.withColumns({"public": F.coalesce("public", empty), "privacy": F.coalesce("privacy", empty)})


def evaluation_sets(done: Prepared) -> tuple[DataFrame, DataFrame]:
    """(records with special contexts, records open to inference)."""
    special = evalsets.special_records(joins.localize(done.local, done.public), joins.localize(done.local, done.private))
    whole = done.private.unionByName(done.public)
    return special, evalsets.inference_open(done.local, done.private, whole).select("rec").distinct()


def score(records: DataFrame, done: Prepared, rewritten: DataFrame, extractor: Callable[[], models.Extractor] = models.rule_extractor) -> tuple[DataFrame, DataFrame]:
    """(retention means, connectivity) of rewritten texts (rec, ctx_pos, text)."""
    predicted = checkpointed(models.extract(rewritten, "text", ["rec", "ctx_pos"], extractor))
    docs = contexts_of(records).select("rec", "ctx_pos")
    rows = metrics.retention_rows(predicted, joins.localize(done.local, done.public), joins.localize(done.local, done.private), docs, ["rec", "ctx_pos"])
    return metrics.retention_macro(rows), metrics.connectivity(metrics.connectivity_rows(done.private, predicted))
