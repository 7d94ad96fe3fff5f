"""Validators: error rows over dynamic JSON, counts, and gates.

Records are VARIANT values in column v with their number in ``line``; a line that is no JSON has v
null. Checks are built-in expressions; an error is a row (line, field), so counts are aggregations. The
reports of RL and SFT records are in reports.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_unit
from ..functions.triples import strip

RETRIEVED, RL, SFT = ("question", "answers", "ctxs"), ("public", "privacy", "ctxs"), ("public", "private", "text", "anonymized_text", "o_public", "o_private")


def kind(v: Column, path: str) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, ... or null where the path is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_there(v: Column, path: str) -> Column:
    """Whether the path exists. A kind names what is inside of a value too, so nothing more than needed asks for it."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def is_text(v: Column, path: str) -> Column:
    return F.coalesce((kind(v, path) == "STRING") & (strip(F.try_variant_get(v, path, "string")) != ""), F.lit(False))


def is_list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def texts_ok(v: Column, path: str) -> Column:
    """A non-empty list of non-empty strings."""
    return is_list(v, path) & (F.size(items(v, path)) > 0) & F.forall(items(v, path), lambda x: is_text(x, "$"))


def repeats(values: Column) -> Column:
    """How many values of an array are repeats of earlier ones, nulls aside."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.size(known) - F.size(F.array_distinct(known))


def errors_of(checks: list[tuple[str, Column]]) -> Column:
    """The (field, n) with errors of one row; each check is a number of errors."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(n.cast("long"), F.lit(0)).alias("n")) for f, n in checks))
    return F.filter(found, lambda e: e["n"] > 0)


def error_rows(records: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(line, field, n): n errors of a field."""
    return records.select("line", F.explode(errors_of(checks)).alias("e")).select("line", "e.field", "e.n")


def _count(bad: Column) -> Column:
    return F.coalesce(bad, F.lit(True)).cast("long")


def retrieved_checks(contexts: int = 10) -> list[tuple[str, Column]]:
    v = F.col("v")
    obj, ctxs = is_object(v), items(v, "$.ctxs")
    whole = obj & is_list(v, "$.ctxs") & (F.size(ctxs) == contexts)
    ids = F.transform(ctxs, lambda c: F.when(kind(c, "$.id") == "STRING", F.try_variant_get(c, "$.id", "string")))
    part = lambda name: F.size(F.filter(ctxs, lambda c: is_object(c) & ~is_text(c, f"$.{name}")))
    return [
        ("record", _count(~obj)),
        ("question", _count(obj & ~is_text(v, "$.question"))),
        ("answers", _count(obj & ~texts_ok(v, "$.answers"))),
        ("ctxs", _count(obj & ~whole)),
        ("ctxs[]", F.when(whole, F.size(F.filter(ctxs, lambda c: ~is_object(c))))),
        *((f"ctxs[].{n}", F.when(whole, part(n))) for n in ("id", "title", "text")),
        ("ctxs[].id repeated", F.when(whole, repeats(ids))),
    ]


def retrieved_errors(records: DataFrame, contexts: int = 10) -> DataFrame:
    return error_rows(records, retrieved_checks(contexts))


def validate_retrieved(records: DataFrame, contexts: int = 10) -> DataFrame:
    """records, contexts (of records with a valid list), invalid_records (which counts errors) and valid."""
    v = F.col("v")
    n = F.size(items(v, "$.ctxs"))
    errors = F.aggregate(errors_of(retrieved_checks(contexts)), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    out = records.agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(F.when(is_object(v) & is_list(v, "$.ctxs") & (n == contexts), n)), F.lit(0)).alias("contexts"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("invalid_records"),
    )
    return out.withColumn("valid", F.col("invalid_records") == 0)


def validate_rl(records: DataFrame, require_qa: bool = False) -> DataFrame:
    """One row of counts over records with their contexts, as reports.rl_counts() makes it."""
    from .reports import describe_rl, rl_counts  # reports stands on this module

    return rl_counts(describe_rl(records, require_qa))


def check_metrics(metrics: DataFrame, expected: DataFrame, key: str, counts: tuple[str, ...], rates: tuple[str, ...]) -> DataFrame:
    """Each expected metric row with valid: counts agree and rates lie in the unit interval."""
    want = expected.select(key, *(F.col(c).alias(f"want_{c}") for c in counts))
    good = F.lit(True)
    for c in counts:
        good = good & F.col(c).eqNullSafe(F.col(f"want_{c}"))
    for r in rates:
        good = good & F.coalesce(in_unit(F.col(r)), F.lit(False))
    return want.join(metrics, key, "left").withColumn("valid", F.coalesce(good, F.lit(False)))


def conserved(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of stages, and whether they are all equal."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.crossJoin(rows.agg((F.min("n") == F.max("n")).alias("conserved")))
