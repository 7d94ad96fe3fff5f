"""Writing JSON lines, CSV, Parquet and reports; Spark's commit protocol publishes whole results only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guard(source: str, target: str) -> None:
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("input and output are the same path")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", order: str | None = None) -> None:
    """Part files with a header each; with an order they form one curve in order of their names."""
    (df.orderBy(order) if order else df).write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def merge_shards(shards: list[DataFrame], index: str) -> DataFrame:
    """Shards in row order; blank lines are gone since they were read."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    return whole.orderBy(index)


def report(df: DataFrame) -> dict:
    """A one-row table as a mapping for a report."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return rows[0].asDict(recursive=True)


def pretty(df: DataFrame) -> str:
    return json.dumps(report(df), ensure_ascii=False, indent=2, default=str) + "\n"


def markdown(df: DataFrame, title: str) -> str:
    rows = "\n".join(f"| {k} | {v} |" for k, v in report(df).items())
    return f"# {title}\n\n| field | value |\n|---|---|\n{rows}\n"


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(file, records, compressed_bytes, sha256) of manifests (v, VARIANT): a list ``artifacts`` of packed files, or a list ``inputs`` of outputs that were packed since.

    Outputs have no packed size. A manifest with neither list is an error.
    """
    outputs = F.try_variant_get("v", "$.inputs", "array<struct<output:string,output_sha256:string,output_records:bigint>>")
    artifacts = F.try_variant_get("v", "$.artifacts", "array<struct<file:string,records:bigint,compressed_bytes:bigint,uncompressed_sha256:string>>")
    entry = lambda file, records, size, digest: F.struct(file.alias("file"), records.alias("records"), size.alias("compressed_bytes"), digest.alias("sha256"))
    packed = F.transform(artifacts, lambda x: entry(x["file"], x["records"], x["compressed_bytes"], x["uncompressed_sha256"]))
    plain = F.transform(outputs, lambda x: entry(F.concat(F.substring_index(x["output"], "/", -1), F.lit(".gz")), x["output_records"], F.lit(None).cast("long"), x["output_sha256"]))
    none = F.raise_error(F.lit("a manifest lists artifacts or inputs")).cast("array<struct<file:string,records:bigint,compressed_bytes:bigint,sha256:string>>")
    return manifests.select(F.explode(F.coalesce(packed, plain, none)).alias("e")).select("e.*")


def verify_artifacts(found: DataFrame, manifest: DataFrame, key: str = "file") -> DataFrame:
    """Manifest rows (file, records, compressed_bytes, sha256) with valid: found, and all three agree."""
    have = found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(key), F.col("lines").alias("f_records"), F.col("compressed_bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    same = F.col("f_records").eqNullSafe(F.col("records")) & (F.col("compressed_bytes").isNull() | F.col("f_bytes").eqNullSafe(F.col("compressed_bytes"))) & F.col("f_sha").eqNullSafe(F.col("sha256"))
    return manifest.join(have, key, "left").withColumn("valid", same).drop("f_records", "f_bytes", "f_sha")
