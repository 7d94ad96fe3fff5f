"""Validation reports: located errors, counts and statistics of record lists.

Every record becomes one narrow row, in one projection over its VARIANT: its errors, each with a place
such as ``ctxs[3].public[1]`` and a message, and its measures, the lengths that are summed up. What
a report shows are aggregations over these rows. A cap on the errors that are shown leaves counts
and validity alone. Medians are exact: values are counted first, and a value's rank is a running sum over the
counts, so only different values meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint
from ..functions.triples import CANONICAL, coerce, is_canonical, is_serialized, part_ok, serialize
from .lineage import checkpointed
from .runs import run_stats
from .validate import RL, SFT, is_list, is_object, is_text, is_there, items, kind, texts_ok

# Fixed values of the reports: what they say of each kind of error.
NO_JSON, NO_OBJECT, MISSING = "invalid JSON", "record must be an object", "missing required field"
NO_LIST, EMPTY_LIST, NO_CONTEXT = "must be a list", "must contain at least one document", "must be an object"
NO_TEXT, NOT_STRING, EMPTY = "must be a non-empty string", "must be a string", "must not be empty"
NO_QUESTION, NO_ANSWERS = "formal RL data require a non-empty question", "formal RL data require a non-empty list of non-empty strings"
REPEATED_ID = "duplicate context ID within query"
NOT_THREE, NOT_STRINGS, BAD_PARTS = "must contain exactly three items", "triple items must be strings", "triple items must not be empty or hold tags"
NOT_TAGGED, MALFORMED, NOT_CANONICAL, NO_TRIPLE = "must be a tagged string", "malformed tagged triple", "tagged triple is not canonical", "expected a neutral tagged string or raw triple"
GLOBAL_OVERLAP, LOCAL_OVERLAP = "global public and private triples overlap", "local public and private triples overlap"

ERROR = "struct<location:string,message:string>"


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _said(place: Column | str, message: Column | str, bad: Column) -> Column:
    """One error, or none."""
    one = F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in (("location", place), ("message", message))))
    return F.when(F.coalesce(bad, F.lit(True)), F.array(one)).otherwise(_none())


def _located(messages: Column, place: Column) -> Column:
    """The errors of a list's elements, from their messages, null where there is none."""
    each = F.transform(messages, lambda m, i: F.when(m.isNotNull(), F.struct(F.concat(place, F.lit("["), i.cast("string"), F.lit("]")).alias("location"), m.alias("message"))))
    return F.filter(each, lambda e: e.isNotNull())


def _judged(good: Column, message: Column) -> Column:
    """An element of a list: its neutral string, or what is wrong with it."""
    return F.struct(good.alias("good"), F.when(good.isNull(), message).alias("message"))


def _raw_item(x: Column) -> Column:
    """A raw triple: a list of three strings."""
    k = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    parts = F.try_variant_get(x, "$", "array<variant>")
    strings = F.forall(parts, lambda p: F.schema_of_variant(p) == "STRING")
    triple = coerce(F.when(k == "ARRAY<STRING>", F.try_variant_get(x, "$", "array<string>")))
    wrong = F.when(~F.startswith(k, F.lit("ARRAY")) | (F.size(parts) != 3), F.lit(NOT_THREE)).when(~strings, F.lit(NOT_STRINGS)).otherwise(F.lit(BAD_PARTS))
    return _judged(F.when(triple.isNotNull(), serialize(triple)), wrong)


def _tagged_item(x: Column) -> Column:
    """A neutral tagged string, to the letter."""
    text = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    wrong = F.when(text.isNull(), F.lit(NOT_TAGGED)).when(F.coalesce(is_serialized(text), F.lit(False)), F.lit(NOT_CANONICAL)).otherwise(F.lit(MALFORMED))
    return _judged(F.when(is_canonical(text), text), wrong)


def _either_item(x: Column) -> Column:
    """A neutral tagged string, or a raw triple."""
    k = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    raw, tagged = _raw_item(x), _tagged_item(x)
    return F.when(k == "STRING", tagged).when(F.startswith(k, F.lit("ARRAY")) & (raw["message"].isNull() | (raw["message"] != NOT_THREE)), raw).otherwise(_judged(F.lit(None).cast("string"), F.lit(NO_TRIPLE)))


def _list(v: Column, path: str, item, whole: str) -> Column:
    """The judged elements of a list. Where all are of the kind ``whole`` and good they are taken at one go."""
    strings = F.try_variant_get(v, path, "array<string>" if whole == "ARRAY<STRING>" else "array<array<string>>")
    quick = F.transform(strings, lambda x: is_canonical(x) if whole == "ARRAY<STRING>" else _plain(x))
    told = F.transform(strings, lambda x: _judged(x if whole == "ARRAY<STRING>" else serialize(_struct(x)), F.lit(None).cast("string")))
    return F.when((kind(v, path) == whole) & F.forall(quick, lambda ok: ok), told).otherwise(F.transform(items(v, path), item))


def _struct(parts: Column) -> Column:
    return F.struct(*(F.get(parts, F.lit(i)).alias(k) for i, k in enumerate("hrt")))


def _plain(parts: Column) -> Column:
    """Whether three strings are a triple that is written as it is."""
    return F.coalesce((F.size(parts) == 3) & F.regexp_like(serialize(_struct(parts)), F.lit(CANONICAL)), F.lit(False))


def _goods(judged: Column) -> Column:
    return F.filter(F.transform(judged, lambda x: x["good"]), lambda x: x.isNotNull())


def _wrongs(v: Column, path: str, judged: Column, place: Column) -> Column:
    return F.concat(_said(place, NO_LIST, ~is_list(v, path)), _located(F.transform(judged, lambda x: x["message"]), place))


def _absent(local: Column, whole: Column, place: Column, what: str) -> Column:
    n = F.size(F.array_except(local, whole))
    return _said(place, F.concat(n.cast("string"), F.lit(what)), n > 0)


def _measure(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("measure"), value.cast("long").alias("value"))


def _counted(name: str, lengths: Column) -> Column:
    return F.transform(lengths, lambda n: _measure(name, n))


def _not_whole(v: Column) -> Column:
    return F.concat(_said("<record>", NO_JSON, v.isNull()), _said("<record>", NO_OBJECT, v.isNotNull() & ~is_object(v)))


def describe_rl(records: DataFrame, require_qa: bool = False) -> DataFrame:
    """line, errors, measures, n_ctxs, empty_public, empty_private of records (line, v); a line that is no JSON has v null.

    Context ids are compared as text. n_ctxs is null where there is no list of contexts, or an empty one.
    """
    v = F.col("v")
    obj = F.coalesce(is_object(v), F.lit(False))
    whole = obj
    for f in RL:
        whole = whole & is_there(v, f"$.{f}")
    listed = whole & is_list(v, "$.ctxs") & (F.size(items(v, "$.ctxs")) > 0)
    base = records.select("line", "v", obj.alias("obj"), whole.alias("whole"), listed.alias("listed"), *(_list(v, f"$.{f}", _raw_item, "ARRAY<ARRAY<STRING>>").alias(f) for f in ("public", "privacy")))
    base = base.select("*", _goods(F.col("public")).alias("g_public"), _goods(F.col("privacy")).alias("g_private"))

    def context(c: Column, k: Column) -> Column:
        place = F.concat(F.lit("ctxs["), k.cast("string"), F.lit("]"))
        named = F.when(is_there(c, "$.id"), F.coalesce(F.try_variant_get(c, "$.id", "string"), F.lit("None")))
        sides = {s: _list(c, f"$.{s}", _either_item, "ARRAY<STRING>") for s in ("public", "private")}
        return F.struct(place.alias("place"), F.coalesce(is_object(c), F.lit(False)).alias("obj"), is_text(c, "$.text").alias("text"), named.alias("id"), *(F.struct(is_list(c, f"$.{s}").alias("list"), j.alias("judged")).alias(s) for s, j in sides.items()))

    ctxs = F.transform(F.when(F.col("listed"), items(v, "$.ctxs")), context)
    rows = base.withColumn("ctxs", ctxs).withColumn("ids", F.transform("ctxs", lambda c: F.when(c["obj"], c["id"])))

    def side(c: Column, s: str, what: str) -> tuple[Column, Column]:
        place = F.concat(c["place"], F.lit(f".{s}"))
        wrong = F.concat(_said(place, NO_LIST, ~c[s]["list"]), _located(F.transform(c[s]["judged"], lambda x: x["message"]), place))
        return wrong, _absent(_goods(c[s]["judged"]), F.col(f"g_{s}"), place, f" local triples are absent from global {what}")

    def told(c: Column, k: Column) -> Column:
        public, private = side(c, "public", "public"), side(c, "private", "privacy")
        again = c["id"].isNotNull() & (F.array_position(F.col("ids"), c["id"]) <= k)
        own = F.concat(_said(F.concat(c["place"], F.lit(".text")), NO_TEXT, ~c["text"]), _said(F.concat(c["place"], F.lit(".id")), REPEATED_ID, F.coalesce(again, F.lit(False))), public[0], private[0], public[1], private[1])
        return F.when(c["obj"], own).otherwise(_said(c["place"], NO_CONTEXT, F.lit(True)))

    head = F.concat(
        *([_said("question", NO_QUESTION, ~is_text(v, "$.question")), _said("answers", NO_ANSWERS, ~texts_ok(v, "$.answers"))] if require_qa else []),
        _wrongs(v, "$.public", F.col("public"), F.lit("public")),
        _wrongs(v, "$.privacy", F.col("privacy"), F.lit("privacy")),
        _said("public/privacy", GLOBAL_OVERLAP, F.arrays_overlap("g_public", "g_private")),
        _said("ctxs", NO_LIST, ~is_list(v, "$.ctxs")),
        _said("ctxs", EMPTY_LIST, is_list(v, "$.ctxs") & (F.size(items(v, "$.ctxs")) == 0)),
        F.flatten(F.coalesce(F.transform("ctxs", told), F.array().cast(f"array<array<{ERROR}>>"))),
    )
    fields = F.concat(*(_said(f, MISSING, F.col("obj") & ~is_there(v, f"$.{f}")) for f in RL))
    kept = F.filter("ctxs", lambda c: c["obj"])
    length = lambda s: F.coalesce(F.transform(kept, lambda c: F.size(_goods(c[s]["judged"]))), F.array().cast("array<int>"))
    lengths = {s: length(s) for s in ("public", "private")}
    out = rows.select("line", F.when(F.col("whole"), head).otherwise(F.concat(_not_whole(v), fields)).alias("errors"), F.size("ctxs").alias("n"), F.col("listed"), *(x.alias(f"n_{s}") for s, x in lengths.items()))
    measures = F.concat(F.when(F.col("listed"), F.array(_measure("contexts_per_query", F.col("n")))).otherwise(F.array().cast("array<struct<measure:string,value:bigint>>")), _counted("local_public_triples_per_document", F.col("n_public")), _counted("local_private_triples_per_document", F.col("n_private")))
    empty = lambda s: F.size(F.filter(f"n_{s}", lambda n: n == 0)).alias(f"empty_{s}")
    return out.select("line", "errors", measures.alias("measures"), F.when(F.col("listed"), F.col("n")).alias("n_ctxs"), empty("public"), empty("private"))


def describe_sft(records: DataFrame) -> DataFrame:
    """line, errors, warnings, measures, repeats and empties of the four lists, fp (of public and private) of flat training rows (line, v)."""
    v = F.col("v")
    obj = F.coalesce(is_object(v), F.lit(False))
    missing = F.filter(F.array(*(F.when(~is_there(v, f"$.{f}"), F.lit(f)) for f in sorted(SFT))), lambda f: f.isNotNull())
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, SFT))))
    lists = {"public": "global_public", "private": "global_private", "o_public": "local_public", "o_private": "local_private"}
    judged = {f: _list(v, f"$.{f}", _tagged_item if f.startswith("o_") else _raw_item, "ARRAY<STRING>" if f.startswith("o_") else "ARRAY<ARRAY<STRING>>") for f in lists}
    rows = records.select("line", "v", obj.alias("obj"), missing.alias("missing"), F.when(obj, extra).alias("extra"), *(c.alias(f"j_{f}") for f, c in judged.items()))
    rows = rows.select("*", *(_goods(F.col(f"j_{f}")).alias(f"g_{f}") for f in lists))
    whole = F.col("obj") & (F.size("missing") == 0)
    named = lambda names: F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    text = lambda f: F.concat(_said(f, NOT_STRING, kind(v, f"$.{f}") != "STRING"), _said(f, EMPTY, (kind(v, f"$.{f}") == "STRING") & ~is_text(v, f"$.{f}")))
    errors = F.concat(
        *(_wrongs(v, f"$.{f}", F.col(f"j_{f}"), F.lit(f)) for f in lists),
        text("text"),
        text("anonymized_text"),
        _said("public/private", GLOBAL_OVERLAP, F.arrays_overlap("g_public", "g_private")),
        _said("o_public/o_private", LOCAL_OVERLAP, F.arrays_overlap("g_o_public", "g_o_private")),
        _absent(F.col("g_o_public"), F.col("g_public"), F.lit("o_public"), " local public triples are absent from global public"),
        _absent(F.col("g_o_private"), F.col("g_private"), F.lit("o_private"), " local private triples are absent from global private"),
    )
    broken = F.concat(_not_whole(v), _said("<record>", F.concat(F.lit("missing fields: "), named(F.col("missing"))), F.col("obj") & (F.size("missing") > 0)))
    chars = lambda f: F.when(kind(v, f"$.{f}") == "STRING", _measure(f"{f}_chars", F.char_length(F.try_variant_get(v, f"$.{f}", "string"))))
    measures = F.filter(F.array(chars("text"), chars("anonymized_text"), *(_measure(f"{name}_triples", F.size(f"g_{f}")) for f, name in lists.items())), lambda m: m.isNotNull())
    fp = fingerprint(F.to_json(F.try_variant_get("v", "$.public", "variant")), F.to_json(F.try_variant_get("v", "$.private", "variant")))
    return rows.select(
        "line",
        F.when(whole, errors).otherwise(broken).alias("errors"),
        F.when(whole, _said("<record>", F.concat(F.lit("extra fields: "), named(F.col("extra"))), F.size("extra") > 0)).otherwise(_none()).alias("warnings"),
        F.when(whole, measures).otherwise(F.array().cast("array<struct<measure:string,value:bigint>>")).alias("measures"),
        *(F.when(whole, F.size(f"g_{f}") - F.size(F.array_distinct(f"g_{f}"))).alias(f"duplicate_{name}") for f, name in lists.items()),
        *(F.when(whole, F.size(f"g_{f}") == 0).alias(f"empty_{name}") for f, name in lists.items()),
        F.when(whole, fp).alias("fp"),
    )


def summary(described: DataFrame, measures: str = "measures") -> DataFrame:
    """(measure, count, min, max, mean, median): exact, over all rows."""
    # Outer, as Spark else evaluates the lists once more to filter the rows that have none.
    values = described.select(F.explode_outer(measures).alias("m")).where("m is not null").select("m.measure", "m.value").groupBy("measure", "value").agg(F.count("*").alias("n"))
    return of_counts(values)


def of_counts(values: DataFrame) -> DataFrame:
    """The summary of values that are counted already: (measure, value, n)."""
    w = Window.partitionBy("measure")
    ranked = values.withColumn("upto", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("value")))
    return ranked.groupBy("measure").agg(
        F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), ((at(low) + at(high)) / 2).alias("median")
    )


def located_errors(described: DataFrame, most: int | None = None, column: str = "errors") -> DataFrame:
    """(line, nth, location, message): the errors in order of lines; ``most`` caps what is shown."""
    rows = described.select("line", F.posexplode_outer(column).alias("nth", "e")).where("e is not null").select("line", "nth", "e.location", "e.message")
    return rows if most is None else rows.orderBy("line", "nth").limit(most)


def rl_counts(described: DataFrame) -> DataFrame:
    """One row: counts and ratios of the RL report, and valid."""
    bad = F.size("errors") > 0
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = described.agg(
        F.count("*").alias("query_count"), some("n_ctxs").alias("document_count"), F.count_if(bad).alias("records_with_errors"), some("empty_public").alias("empty_local_public"), some("empty_private").alias("empty_local_private"), some(F.size("errors")).alias("errors")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*",
        ratio("empty_local_public", "document_count").alias("empty_local_public_ratio"),
        ratio("empty_local_private", "document_count").alias("empty_local_private_ratio"),
        ratio("records_with_errors", "query_count").alias("malformed_record_ratio"),
        (F.col("records_with_errors") == 0).alias("valid"),
    )


def sft_counts(described: DataFrame) -> DataFrame:
    """One row: counts of the SFT report, and valid."""
    bad = F.size("errors") > 0
    names = ("global_public", "global_private", "local_public", "local_private")
    return described.agg(
        F.count("*").alias("records_total"),
        F.count_if(bad).alias("records_with_errors"),
        F.count_if(~bad).alias("records_valid"),
        F.count_if(F.size("warnings") > 0).alias("records_with_warnings"),
        *(F.coalesce(F.sum(f"duplicate_{n}"), F.lit(0)).alias(f"duplicate_{n}") for n in names),
        *(F.count_if(f"empty_{n}").alias(f"empty_{n}") for n in names),
    ).withColumn("valid", F.col("records_with_errors") == 0)


def report(described: DataFrame, kind_: str, examples: int = 100) -> dict:
    """The whole report of described records: counts, statistics, the first errors (and groups and warnings of SFT rows).

    What comes to the driver is one row of counts, a row per measure and ``examples`` errors at most.
    """
    rows = checkpointed(described)
    one = lambda df: df.first().asDict()
    shown = lambda column: [r.asDict() for r in located_errors(rows, examples, column).drop("nth").collect()]
    out = {"counts": one(rl_counts(rows) if kind_ == "rl" else sft_counts(rows)), "statistics": {r.measure: {k: r[k] for k in ("count", "min", "max", "mean", "median")} for r in summary(rows).collect()}, "errors": shown("errors")}
    out["valid"] = out["counts"].pop("valid")
    if kind_ == "sft":
        out["warnings"], out["groups"] = shown("warnings"), one(run_stats(rows.where("fp is not null").select("line", "fp"), "line", "fp"))
    return out
