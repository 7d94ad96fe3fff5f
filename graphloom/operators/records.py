"""Building and reshaping question-answer records."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.triples import SPACE, strip

CONTEXT = "struct<id:string,title:string,text:string>"


def required_text(text: Column, what: str) -> Column:
    """The stripped text; an empty or missing one is an error."""
    bare = strip(text)
    return F.when(bare.isNull() | (bare == ""), F.raise_error(F.lit(f"{what} must be a non-empty string"))).otherwise(bare)


def first_of_each_key(maps: DataFrame, keys: tuple[str, ...], items: str) -> DataFrame:
    """Flattens an array of maps; of a key that several maps have, the first map's value stays.

    (keys, key, value, pos), where pos is the map's place.
    """
    long = maps.select(*keys, F.posexplode(items).alias("pos", "m")).select(*keys, "pos", F.explode("m").alias("key", "value"))
    w = Window.partitionBy(*keys, "key").orderBy("pos")
    return long.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def long_triples(records: DataFrame, rec: str = "rec") -> DataFrame:
    """Records with ctxs and triplets (an array of maps from id to lists) as triples(rec, ctx_id, ctx_pos, t_pos, h, r, t)."""
    ctxs = records.select(rec, F.posexplode("ctxs").alias("ctx_pos", "c")).select(rec, "ctx_pos", F.col("c.id").cast("string").alias("ctx_id"))
    found = first_of_each_key(records, (rec,), "triplets").select(rec, F.col("key").alias("ctx_id"), F.posexplode("value").alias("t_pos", "x"))
    return ctxs.join(found, [rec, "ctx_id"]).select(rec, "ctx_id", "ctx_pos", "t_pos", F.get("x", F.lit(0)).alias("h"), F.get("x", F.lit(1)).alias("r"), F.get("x", F.lit(2)).alias("t"))


def flatten_examples(records: DataFrame, rec: str = "rec", least_public: int = 5, least_private: int = 2) -> DataFrame:
    """One row per context with enough distinct local triples, with its place of origin."""
    rows = records.select(rec, F.posexplode("ctxs").alias("ctx_pos", "c"))
    public, private = F.array_distinct("c.public"), F.array_distinct("c.private")
    return rows.where((F.size(public) >= least_public) & (F.size(private) >= least_private)).select(rec, "ctx_pos", F.col("c.text").alias("text"), public.alias("public"), private.alias("private"))


def flatten_counts(records: DataFrame, least_public: int = 5, least_private: int = 2, source: str | None = None) -> DataFrame:
    rows = records.select(*([source] if source else []), F.explode("ctxs").alias("c"))
    good = (F.size(F.array_distinct("c.public")) >= least_public) & (F.size(F.array_distinct("c.private")) >= least_private)
    return rows.groupBy(*([source] if source else [])).agg(F.count("*").alias("seen"), F.count_if(good).alias("kept"), F.count_if(~good).alias("filtered"))


def zipped_contexts_ok(titles: Column, sentences: Column, k: int) -> Column:
    return F.coalesce((F.size(titles) == F.size(sentences)) & (F.size(titles) >= k), F.lit(False))


def ranked_contexts(docs: Column, dataset: str, source: Column, k: int) -> Column:
    """The first k documents <title, text> with ids dataset:source:rank, rank from 1."""
    return F.transform(F.slice(docs, 1, k), lambda d, i: F.struct(F.concat_ws(":", F.lit(dataset), source.cast("string"), (i + 1).cast("string")).alias("id"), strip(d["title"]).alias("title"), strip(d["text"]).alias("text")))


def record_metadata(dataset: str, index: Column, source: Column, k: int) -> Column:
    return F.struct(F.lit(dataset).alias("dataset"), index.cast("long").alias("source_index"), source.cast("string").alias("source_id"), F.lit(k).alias("retrieval_top_k"))


def retrieved_records(rows: DataFrame, dataset: str, k: int = 10) -> DataFrame:
    """question, answers, ctxs, metadata from (index, id, question, answers, docs); too few documents are an error."""
    docs = F.when(F.size("docs") < k, F.raise_error(F.lit(f"fewer than {k} documents"))).otherwise(F.col("docs"))
    return rows.select(required_text(F.col("question"), "question").alias("question"), "answers", ranked_contexts(docs, dataset, F.col("id"), k).alias("ctxs"), record_metadata(dataset, F.col("index"), F.col("id"), k).alias("metadata"))


def zipped_documents(titles: Column, sentences: Column) -> Column:
    """Titles and lists of sentences as documents; blank sentences go, the rest stand with single spaces."""
    return F.transform(F.arrays_zip(titles.alias("a"), sentences.alias("b")), lambda z: F.struct(z["a"].alias("title"), F.array_join(F.filter(F.transform(z["b"], strip), lambda s: s != ""), " ").alias("text")))


def answers_lower(values: Column) -> Column:
    """Stripped answers without blanks; of those alike but for case the first spelling stays (by lower())."""
    bare = F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != ""))
    low = F.transform(bare, F.lower)
    return F.filter(bare, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def _literal(value: str):
    for read in (json.loads, ast.literal_eval):
        try:
            return read(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    return value


@F.pandas_udf(ArrayType(StringType()))
def answers_exact(values: pd.Series) -> pd.Series:
    """Answers from a string that may be a JSON or Python list; distinct by casefold, first spelling kept."""

    def one(value):
        found = _literal(value.strip()) if isinstance(value, str) and value.strip()[:1] in ("[", "(", '"', "'") else value
        items = list(found) if isinstance(found, (list, tuple)) else [found]
        out = {}
        for x in items:
            if isinstance(x, str) and x.strip():
                out.setdefault(x.strip().casefold(), x.strip())
        return list(out.values())

    return values.map(one)


@F.pandas_udf(StringType())
def as_json(values: pd.Series) -> pd.Series:
    """Mapping texts in Python's notation as JSON; others as they are. Run before parse_document() where both occur."""

    def one(value):
        found = _literal(value.strip()) if isinstance(value, str) and value.strip()[:1] == "{" else value
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else value

    return values.map(one)


def redact_tree(value: Column, prefix: str) -> Column:
    """A JSON text in which every string, at any depth, has the path prefix taken out; null if it is no JSON."""
    bare = prefix.rstrip("/")

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, str):
            return "." if x == bare else x.replace(f"{bare}/", "")
        return x

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(clean(json.loads(text)), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return run(value)


def parse_document(value: Column) -> Column:
    """<title, text> from a document string: JSON object, "Title: ... Content: ..." text, or first line and rest."""
    v = F.try_parse_json(value)
    get = lambda *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))
    marked = rf"(?is)\A{SPACE}*title:{SPACE}*([^\n]*?){SPACE}*\n{SPACE}*content:{SPACE}*(.*)\z"
    split_at = F.locate("\n", value)
    return (
        F.when(F.startswith(strip(value), F.lit("{")) & get("text", "content", "contents").isNotNull(), F.struct(F.coalesce(strip(get("title", "page_title")), F.lit("")).alias("title"), strip(get("text", "content", "contents")).alias("text")))
        .when(F.regexp_like(value, F.lit(marked)), F.struct(F.regexp_extract(value, marked, 1).alias("title"), strip(F.regexp_extract(value, marked, 2)).alias("text")))
        .when(split_at > 0, F.struct(strip(F.substring(value, F.lit(1), split_at - 1)).alias("title"), strip(F.substring(value, split_at + 1, F.char_length(value))).alias("text")))
        .otherwise(F.struct(F.lit("").alias("title"), strip(value).alias("text")))
    )


def group_context(group: Column, doc: Column) -> Column:
    return F.format_string("regrouped-%06d-doc-%02d", group.cast("int"), doc.cast("int"))


def rewrites_of(one: Column, many: Column) -> Column:
    """A list of rewrites: null is none, a single string one; ``many`` stands where ``one`` is null."""
    return F.coalesce(F.when(one.isNotNull(), F.array(one)), many)


def question_of(qa: Column, question: Column) -> Column:
    """The first qa item's question where there is a qa list, else the record's own."""
    return F.coalesce(F.try_element_at(qa, F.lit(1))["question"], question)


def with_question(records: DataFrame, qa: str = "qa", question: str = "question") -> DataFrame:
    """The records with the question to ask in ``question``; those whose qa list is there but empty go."""
    there = records.where(F.col(qa).isNull() | (F.size(qa) > 0))
    return there.withColumn(question, question_of(F.col(qa), F.col(question)))


def rewritten(records: DataFrame, rewrites: Column) -> DataFrame:
    """The records with rewrites in place with their contexts; another number is an error."""
    return records.withColumn("anonymized_ctxs", F.when(F.size(rewrites) != F.size("ctxs"), F.raise_error(F.lit("rewrites and contexts differ in number"))).otherwise(rewrites))
