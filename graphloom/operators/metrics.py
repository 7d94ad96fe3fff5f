"""Retention, connectivity, recall and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, edges_of, reachable


def retention(predicted: Column, reference: Column, empty: float) -> Column:
    """Share of the distinct reference triples that are predicted; ``empty`` where there are none."""
    n = F.size(F.array_distinct(reference))
    return F.when(n == 0, F.lit(float(empty))).otherwise(F.size(F.array_intersect(predicted, reference)) / n)


def retention_rows(predicted: DataFrame, public: DataFrame, private: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """r_pub and r_pri per document from long tables, by one aggregation over their union."""
    item = [*keys, "h", "r", "t"]
    mark = lambda x, **m: x.select(*item, *(F.lit(m.get(c, 0)).alias(c) for c in ("p", "pub", "pri")))
    rows = mark(predicted, p=1).unionByName(mark(public, pub=1)).unionByName(mark(private, pri=1))
    each = rows.groupBy(*item).agg(*(F.max(c).alias(c) for c in ("p", "pub", "pri")))
    sums = each.groupBy(*keys).agg(F.sum("pub").alias("n_pub"), F.sum("pri").alias("n_pri"), F.sum(F.col("p") * F.col("pub")).alias("k_pub"), F.sum(F.col("p") * F.col("pri")).alias("k_pri"))
    full = documents.select(*keys).distinct().join(sums, keys, "left").na.fill(0)
    return full.select(*keys, "n_pub", "n_pri", "k_pub", "k_pri", F.when(F.col("n_pub") == 0, 1.0).otherwise(F.col("k_pub") / F.col("n_pub")).alias("r_pub"), F.when(F.col("n_pri") == 0, 0.0).otherwise(F.col("k_pri") / F.col("n_pri")).alias("r_pri"))


def retention_macro(rows: DataFrame) -> DataFrame:
    """Means over all documents, empty references too, with counts."""
    return rows.agg(F.count("*").alias("documents"), F.avg("r_pub").alias("r_pub"), F.avg("r_pri").alias("r_pri"), F.count_if(F.col("n_pub") == 0).alias("empty_public"), F.count_if(F.col("n_pri") == 0).alias("empty_private"))


def connectivity_rows(private: DataFrame, predicted: DataFrame, rec: str = "rec") -> DataFrame:
    """Per record: private triples, repeats counted, and how many the rewritten graph connects."""
    edges = predicted.where("h <> t").select(rec, "h", "t").distinct()
    found = reachable(private.select(rec, F.col("h").alias("a"), F.col("t").alias("b")), components(edges_of(edges, [rec]), [rec]), [rec])
    hit = found.select(rec, F.col("a").alias("h"), F.col("b").alias("t"), F.lit(1).alias("hit"))
    return private.join(hit, [rec, "h", "t"], "left").groupBy(rec).agg(F.count("*").alias("private_triples"), F.count("hit").alias("connected"))


def connectivity(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("records"), F.sum("private_triples").alias("private_triples"), F.sum("connected").alias("connected"), F.avg(F.col("connected") / F.col("private_triples")).alias("macro"), (F.sum("connected") / F.nullif(F.sum("private_triples"), F.lit(0))).alias("micro"))


def recall_report(rows: DataFrame) -> DataFrame:
    """Micro and macro recall; the macro means leave empty references out; null without any."""
    total = F.col("n_pub") + F.col("n_pri")
    hit = F.col("k_pub") + F.col("k_pri")
    micro = lambda x: F.sum(f"k_{x}") / F.nullif(F.sum(f"n_{x}"), F.lit(0))
    macro = lambda x: F.avg(F.when(F.col(f"n_{x}") > 0, F.col(f"k_{x}") / F.col(f"n_{x}")))
    return rows.agg(
        F.count("*").alias("samples"),
        micro("pub").alias("public_micro"),
        micro("pri").alias("private_micro"),
        macro("pub").alias("public_macro"),
        macro("pri").alias("private_macro"),
        F.count_if((total > 0) & (hit == 0)).alias("zero_match"),
        F.count_if(hit == total).alias("fully_recovered"),
        F.count_if(hit < total).alias("mismatch"),
    )


def gate(report: DataFrame, least: float = 0.8) -> DataFrame:
    """pass if all four recalls are there and large enough, else fail."""
    good = F.lit(True)
    for c in ("public_micro", "private_micro", "public_macro", "private_macro"):
        good = good & F.coalesce(F.col(c) >= least, F.lit(False))
    return report.withColumn("gate_status", F.when(good, "pass").otherwise("fail"))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, max, mean and median; nulls where there is nothing."""
    out = (F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def phases(rows: DataFrame, phase: str, step: str, values: tuple[str, ...]) -> DataFrame:
    """First and last step, count and means of each phase, and of all (phase null), in one rollup."""
    return rows.rollup(phase).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def batch_means(rows: DataFrame, index: str, size: int, values: tuple[str, ...]) -> DataFrame:
    """(batch, n, mean_...) of batches of ``size`` numbered rows, the last one possibly smaller; for rewards and for seconds."""
    return rows.groupBy(F.floor(F.col(index) / size).cast("long").alias("batch")).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def tail_multimap(triples: DataFrame, rec: str = "rec") -> DataFrame:
    """For each tail the distinct (head, relation) pairs."""
    return triples.groupBy(rec, "t").agg(F.array_sort(F.collect_set(F.struct("h", "r"))).alias("pairs"))


def skip_status(rewrites: Column, contexts: Column, privacy: Column) -> Column:
    """Why an evaluator leaves a record out; evaluated if it does not."""
    return F.when(rewrites.isNull() | (F.size(rewrites) == 0), "no_rewrites").when(F.size(rewrites) != F.size(contexts), "alignment_mismatch").when(F.coalesce(F.size(privacy), F.lit(0)) <= 0, "empty_privacy").otherwise("evaluated")
