"""Reading JSON, JSON lines, Parquet, gzip and log text, with row numbers where order is data."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import TIMESTAMP, log_count, log_number, log_time
from ..functions.triples import SPACE
from .jsontext import json_after, json_after_marker, json_elements

__all__ = ["count_lines", "dotted", "fetch", "file_digests", "inspect_gzip", "json_after", "json_after_marker", "json_array", "json_elements", "json_lines", "last_checkpoint", "numbered", "parquet_in_order", "text_lines", "training_log", "yaml_mapping"]

SPLIT = ("_file", "_block")


def _shifted(rows: DataFrame, keys: tuple[str, ...], place: Column, name: str) -> DataFrame:
    """Adds ``name``: the place inside a group, from 0, plus the rows of all groups before it in order of the keys.

    Only one row per group, with its count, meets the others in a window.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return rows.withColumn("_place", place).join(offsets, list(keys)).withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_place", "_before")


def numbered(df: DataFrame, name: str = "rec", order: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows numbered from 0: by ``order`` inside of the groups ``within``, whose keys' order is the groups'.

    Without an order it is that of partitions and of the rows inside of them; then the rows come
    straight from a scan, so that each evaluation finds them in the same places.
    """
    if order is not None:
        return _shifted(df, within, F.row_number().over(Window.partitionBy(*within).orderBy(order)) - 1, name)
    marked = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    return _shifted(marked, ("_part",), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), name).drop("_id", "_part")


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines numbered from 1 in order of files and of the blocks inside of them, with their file and block."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return numbered(raw.withColumn("_id", F.monotonically_increasing_id()), name, "_id", SPLIT).withColumn(name, F.col(name) + 1).drop("_id")


def text_lines(spark: SparkSession, path: str, blanks: str = "skip", name: str = "line", keep_split: bool = False) -> DataFrame:
    """(line, value): lines numbered from 1 over the files. Blank ones are skipped, kept or an error."""
    lines = _lines(spark, path, name)
    blank = F.regexp_like("value", F.lit(rf"\A{SPACE}*\z"))
    if blanks == "skip":
        lines = lines.where(~blank)
    elif blanks == "error":
        lines = lines.withColumn("value", F.when(blank, F.raise_error(F.concat(F.lit("blank line "), F.col(name).cast("string")))).otherwise(F.col("value")))
    return lines.select(name, "value", *(SPLIT if keep_split else ()))


def json_lines(spark: SparkSession, path: str, blanks: str = "skip", bad: str = "error", limit: int | None = None, start: int = 0) -> DataFrame:
    """(line, rec, v): JSON lines as VARIANT; rec numbers those that are emitted, from 0.

    ``bad="error"`` fails on what is not an object, with its line; ``bad="null"`` gives what is no JSON as null and other values as they are.
    ``start`` and ``limit`` cut by rec.
    """
    rows = numbered(text_lines(spark, path, blanks, keep_split=True), "rec", "line", SPLIT).withColumn("v", F.try_parse_json("value"))
    if bad == "error":
        obj = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
        rows = rows.withColumn("line", F.when(~obj, F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("line").cast("string")))).otherwise(F.col("line")))
    last = start + limit - 1 if limit is not None else (1 << 62)
    return rows.where(F.col("rec").between(start, last)).select("line", "rec", "v")


def json_array(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON files that hold an array each, or one object, as rows in order of files and elements.

    Rows are numbered (rec, from 0); ``limit`` keeps the first. With a schema they have its columns, and an
    element that does not fit is an error; without one they have v, a VARIANT.
    """
    rows = json_elements(spark, path)
    sizes = rows.groupBy("file").agg(F.max("element").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered_rows = rows.join(F.broadcast(before), "file").select((F.col("before") + F.col("element")).alias("rec"), "v")
    kept = numbered_rows if limit is None else numbered_rows.where(F.col("rec") < limit)
    if schema is None:
        return kept
    return kept.select("rec", F.variant_get("v", "$", StructType.fromDDL(schema).simpleString()).alias("row")).orderBy("rec").select("row.*")


def parquet_in_order(spark: SparkSession, paths: list[str], columns: list[str], index: str = "row") -> DataFrame:
    """Several Parquet files in sorted order of their paths, numbered from 0 over all, only the named columns.

    Numbers come from each file's own row index and the files' row counts; no row moves.
    """
    have = {c for p in paths for c in spark.read.parquet(p).columns}
    rows = None
    for k, p in enumerate(sorted(paths)):
        df = spark.read.parquet(p)
        one = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns if c in have), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"), F.lit(k).alias("_nth"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    counts = rows.groupBy("_nth", "_file").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_nth", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(offsets, ["_nth", "_file"]).select((F.col("_offset") + F.col("_place")).alias(index), *(c for c in columns if c in have))


def fetch(rows: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """The rows at the wanted positions; one that is missing is an error."""
    keys = rows.sparkSession.createDataFrame([(i,) for i in wanted], f"{index} long")
    found = keys.join(rows.withColumn("there", F.lit(True)), index, "left")
    return found.withColumn(index, F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no row "), F.col(index).cast("string")))).otherwise(F.col(index))).drop("there")


def count_lines(spark: SparkSession, path: str, blanks: bool = False) -> int:
    lines = spark.read.text(path)
    return lines.count() if blanks else lines.where(~F.regexp_like("value", F.lit(rf"\A{SPACE}*\z"))).count()


def _streamed(rows: DataFrame) -> DataFrame:
    """(path, with_end, without_end, lines) of rows (path, start, value) that hold each file's lines in order: digests with and without the last line feed.

    start is what stands before the first line.

    A task holds one line and the state of a digest, whatever the file's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, whole, cut, lines = None, hashlib.sha256(), None, 0
        names = ["path", "with_end", "without_end", "lines"]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(names, ([path], [whole.hexdigest()], [cut.hexdigest()], [lines]), strict=True)))

        for batch in batches:
            for here, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if here != path:
                    if path is not None:
                        yield told()
                    path, whole, lines = here, hashlib.sha256(start), 0
                data = value.as_py()
                whole.update(data)
                cut = whole.copy()
                whole.update(b"\n")
                lines += bool(data.strip())
        if path is not None:
            yield told()

    return rows.mapInArrow(run, "path string, with_end string, without_end string, lines long")


def _bytes_of(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(path, n): the files' unpacked bytes, and one more where the last byte is not ``end``."""
    read = spark.read.option("lineSep", end).text(path)
    return read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.octet_length("value") + 1).alias("n"))


def inspect_gzip(spark: SparkSession, path: str) -> DataFrame:
    """path, compressed_bytes, sha256 and lines (that are not blank) of packed files, of their unpacked bytes.

    A packed file is one task's stream of lines. Whether it ends with a line feed tells a second count of its bytes,
    with another end of line. An empty file has the digest of nothing. Spark's readers leave out a byte
    order mark at a file's start, so a packed file that has one is digested without.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("compressed_bytes"))
    told = _streamed(spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.lit(b"").alias("start"), F.col("value").cast("binary").alias("value")))
    ended = _bytes_of(spark, path, "\n").join(_bytes_of(spark, path, "\0").withColumnRenamed("n", "other"), "path").select("path", (F.col("n") < F.col("other")).alias("ended"))
    digest = F.coalesce(F.when(F.col("ended"), F.col("with_end")).otherwise(F.col("without_end")), F.lit(hashlib.sha256().hexdigest()))
    both = told.join(ended, "path")
    return _by_path(files, both).select("path", "compressed_bytes", digest.alias("sha256"), F.coalesce("lines", F.lit(0)).alias("lines"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of plain files: their lines go to one task a file, in order, and are digested as they come. Scans leave out empty files."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    meta = lambda name: F.col(f"_metadata.{name}")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta("file_path").alias("path"), meta("file_size").alias("_size"), meta("file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("value"))
    # Readers leave out a byte order mark, of three bytes, which the file's size shows.
    short = F.sum(F.octet_length("value") + 1) - F.max("_size")
    sizes = rows.groupBy("path").agg(F.when(short < -1, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")).alias("start"), short.isin(0, -3).alias("ended"))
    told = _streamed(rows.join(F.broadcast(sizes), "path").repartition("path").sortWithinPartitions("path", "_block", "_id").select("path", "start", "value"))
    digest = F.coalesce(F.when(F.col("ended"), F.col("with_end")).otherwise(F.col("without_end")), F.lit(hashlib.sha256().hexdigest()))
    return _by_path(files, told.join(sizes, "path")).select("path", "length", digest.alias("sha256"))


def _by_path(files: DataFrame, told: DataFrame) -> DataFrame:
    """The files with what is told of them; both sides may write a path's scheme in their own way."""
    bare = lambda c: F.regexp_replace(F.try_url_decode(c), "^[a-z]+:/+", "/")
    return files.withColumn("_bare", bare("path")).join(told.withColumn("_bare", bare("path")).drop("path"), "_bare", "left").drop("_bare")


def training_log(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(reward rows, update rows) of a training log: the lines that have a time and all fields of their kind, in any order."""
    line = F.col(value)
    stamp = F.regexp_extract(line, TIMESTAMP, 0)
    at = F.when(stamp != "", log_time(stamp))
    numbers = {"mean_reward": "mean_reward", "mean_r_pub": "mean_r_pub", "mean_r_pri": "mean_r_pri", "learning_rate": "lr"}
    first = lines.select(log_count(line, "step").alias("step"), log_count(line, "p").alias("p"), at.alias("reward_timestamp"), *(log_number(line, f).alias(c) for c, f in numbers.items()))
    second = lines.select(log_count(line, "step").alias("step"), at.alias("update_timestamp"), *(log_number(line, c).alias(c) for c in ("update_seconds", "kl")))
    return first.dropna(), second.dropna()


def last_checkpoint(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """The path that the last checkpoint line names."""
    path = F.regexp_extract(value, r"Saved final checkpoint: (\S+)", 1)
    return lines.select(path.alias("path"), order).where("path <> ''").agg(F.max_by("path", order).alias("path"))


def yaml_mapping(path: str) -> dict:
    """A configuration file; its top level is a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise TypeError("the configuration is no mapping")
    return found


def dotted(config: dict, path: str, *default):
    """config["a"]["b"] for "a.b"; a missing one is an error unless there is a default."""
    at = config
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            if default:
                return default[0]
            raise KeyError(path)
        at = at[key]
    return at
