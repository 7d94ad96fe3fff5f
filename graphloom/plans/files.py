"""Queries of sources and sinks: each writes a table into a folder of its own, reads it back and removes the folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, selection
from ..operators.lineage import checkpointed, scratch
from ..sources import ingest, sinks
from . import bridge
from .bridge import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BLANK = "'^[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*$'"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with scratch(spark) as folder:
                return checkpointed(f(spark, sf_dir, folder))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str, folder: str) -> str:
    sinks.write_json_lines(table(spark, d, "documents").select("doc_id", "text").orderBy("doc_id"), f"{folder}/docs")
    return f"{folder}/docs"


def field(name: str, kind: str) -> F.Column:
    return F.try_variant_get("v", f"$.{name}", kind)


NUMBERED = "WITH n AS (SELECT doc_id, sha256(text) AS digest, row_number() OVER (ORDER BY doc_id) AS line FROM documents) SELECT line, line - 1 AS rec, doc_id, digest FROM n"


@query(NUMBERED)
def json_lines_scan(spark, d, folder):
    rows = ingest.json_lines(spark, _documents(spark, d, folder), blanks="error")
    return rows.select("line", "rec", field("doc_id", "long").alias("doc_id"), F.sha2(field("text", "string"), 256).alias("digest"))


@query(f"{NUMBERED} WHERE line BETWEEN 101 AND 150")
def json_lines_slice(spark, d, folder):
    rows = ingest.json_lines(spark, _documents(spark, d, folder), start=100, limit=50)
    return rows.select("line", "rec", field("doc_id", "long").alias("doc_id"), F.sha2(field("text", "string"), 256).alias("digest"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events)
SELECT line, row_number() OVER (ORDER BY line) - 1 AS rec, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN event_id END AS event_id FROM n WHERE event_id % 7 <> 0""")
def json_lines_broken(spark, d, folder):
    i = F.col("event_id")
    line = F.when(i % 7 == 0, " \t").when(i % 11 == 0, '{"event_id": ').when(i % 13 == 0, "[1]").otherwise(F.to_json(F.struct("event_id")))
    table(spark, d, "events").orderBy("event_id").select(line.alias("value")).write.text(f"{folder}/lines")
    return ingest.json_lines(spark, f"{folder}/lines", bad="null").select("line", "rec", field("event_id", "long").alias("event_id"))


@query(f"WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT count(*) FILTER (WHERE NOT regexp_matches(line, {BLANK})) AS filled, count(*) AS lines FROM l")
def line_counts(spark, d, folder):
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(f"{folder}/text")
    counts = ingest.count_lines(spark, f"{folder}/text"), ingest.count_lines(spark, f"{folder}/text", blanks=True)
    return spark.createDataFrame([counts], "filled long, lines long")


@query("SELECT 'array' AS kind, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT 'object', CAST(n_nationkey AS BIGINT), n_name FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)")
def json_array_scan(spark, d, folder):
    """An array is one value of one file, so the table is the one of fixed size."""
    row = F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    nations = table(spark, d, "nation")
    nations.agg(F.to_json(F.collect_list(row)).alias("value")).write.text(f"{folder}/array")
    nations.agg(F.to_json(F.min_by(row, "n_nationkey")).alias("value")).write.text(f"{folder}/object")
    read = lambda kind: ingest.json_array(spark, f"{folder}/{kind}", "n_nationkey long, n_name string").select(F.lit(kind).alias("kind"), "*")
    return read("array").unionByName(read("object"))


def _orders(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Orders in two files' worth of folders, even keys first, numbered over both."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    for k in (1, 0):
        sinks.write_parquet(orders.where(F.col("o_orderkey") % 2 == k).orderBy("o_orderkey"), f"{folder}/part{k}")
    return ingest.parquet_in_order(spark, [f"{folder}/part1", f"{folder}/part0"], ["o_orderkey", "o_custkey", "unheard_of"])


ORDERED = 'WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS "row", o_orderkey, o_custkey FROM orders) SELECT * FROM n'


@query(ORDERED)
def parquet_numbered(spark, d, folder):
    return _orders(spark, d, folder)


@query(f'{ORDERED} WHERE "row" IN (0, 3, 77, 200)')
def indexed_fetch(spark, d, folder):
    return ingest.fetch(_orders(spark, d, folder), "row", [200, 0, 77, 3])


@query("SELECT event_id + 1 AS step, CAST((event_id * 7 % 1000) / 1000.0 AS DOUBLE) AS mean_reward, CAST(-((event_id * 19 % 1000) / 1000.0) AS DOUBLE) AS kl FROM events")
def csv_curve(spark, d, folder):
    a, b = ingest.training_log(bridge.log_lines(spark, d))
    sinks.write_csv(joins.merge_steps(a, b).select("step", "mean_reward", "kl"), f"{folder}/curve", order="step")
    return spark.read.option("header", True).option("enforceSchema", False).schema("step long, mean_reward double, kl double").csv(f"{folder}/curve")


@query("WITH n AS (SELECT count(*) // 8 + 1 AS size FROM documents) SELECT doc_id, doc_id // size AS chunk, CAST(n_chars AS BIGINT) AS n_chars FROM documents, n")
def shard_merge(spark, d, folder):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    selection.chunks(docs, "doc_id", docs.count() // 8 + 1).write.partitionBy("chunk").parquet(f"{folder}/shards")
    whole = spark.read.parquet(f"{folder}/shards").withColumn("chunk", F.col("chunk").cast("long"))
    return sinks.merge_shards([whole.where("chunk >= 4"), whole.where("chunk < 4")], "doc_id")


@query("WITH s AS (SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, count(*) AS lines FROM nation) SELECT 'gzip' AS kind, sha256, lines, TRUE AS valid FROM s UNION ALL SELECT 'plain', sha256, NULL, NULL FROM s")
def artifact_digests(spark, d, folder):
    """Digests and line counts of a file, packed and plain, and the manifest's verdict on it; the table is the one of fixed size."""
    names = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name")
    names.write.option("compression", "gzip").text(f"{folder}/packed")
    names.write.text(f"{folder}/plain")
    found = checkpointed(ingest.inspect_gzip(spark, f"{folder}/packed/*.gz"))
    base = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    manifest = found.select(base, F.col("lines").alias("records"), F.lit(None).cast("long").alias("compressed_bytes"), "sha256")
    packed = sinks.verify_artifacts(found, manifest).select(F.lit("gzip").alias("kind"), "sha256", F.col("records").alias("lines"), "valid")
    plain = ingest.file_digests(spark, f"{folder}/plain/*.txt").select(F.lit("plain").alias("kind"), "sha256", F.lit(None).cast("long").alias("lines"), F.lit(None).cast("boolean").alias("valid"))
    return packed.unionByName(plain)


@query("""WITH f AS (SELECT doc_id % 4 AS k, sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id)) AS sha256, count(*) AS lines FROM documents GROUP BY 1), k AS (SELECT unnest(['artifacts', 'inputs']) AS form)
SELECT form, CAST(k AS BIGINT) AS k, sha256, lines, k <> 3 AS valid FROM f, k""")
def artifact_manifests(spark, d, folder):
    """Packed files of document ids against manifests of both forms, in which the last file's count is wrong."""
    ids = table(spark, d, "documents").select("doc_id")
    for k in range(4):
        ids.where(F.col("doc_id") % 4 == k).coalesce(1).sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string")).write.option("compression", "gzip").text(f"{folder}/packed/{k}")
    found = checkpointed(ingest.inspect_gzip(spark, f"{folder}/packed/*/*.gz").withColumn("k", F.regexp_extract("path", r"/(\d)/[^/]*$", 1).cast("long")))
    name, told = F.regexp_extract("path", r"([^/]+)$", 1), F.col("lines") + F.when(F.col("k") == 3, 1).otherwise(0)
    entries = {
        "artifacts": F.struct(name.alias("file"), told.alias("records"), "compressed_bytes", F.col("sha256").alias("uncompressed_sha256")),
        "inputs": F.struct(F.concat(F.lit("/out/"), F.regexp_replace(name, r"\.gz$", "")).alias("output"), F.col("sha256").alias("output_sha256"), told.alias("output_records")),
    }
    rows = None
    for form, entry in entries.items():
        found.agg(F.to_json(F.struct(F.collect_list(entry).alias(form)))).write.text(f"{folder}/{form}")
        judged = sinks.verify_artifacts(found, sinks.manifest_entries(ingest.json_elements(spark, f"{folder}/{form}")))
        one = judged.join(found.select(name.alias("file"), "k", "lines"), "file").select(F.lit(form).alias("form"), "k", "sha256", "lines", "valid")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT row_number() OVER (ORDER BY doc_id % 16, doc_id) - 1 AS rec, doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def json_array_blocks(spark, d, folder):
    """All documents in sixteen files, each of which is one JSON array, read by blocks."""
    docs = table(spark, d, "documents").select(F.lpad((F.col("doc_id") % 16).cast("string"), 2, "0").alias("file"), "doc_id", F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("item"))
    ends = docs.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    mark = lambda end, yes, no: F.when(F.col("doc_id") == F.col(end), yes).otherwise(no)
    rows = docs.join(F.broadcast(ends), "file").select("file", "doc_id", F.concat(mark("first", "[", ""), "item", mark("last", "]", ",")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(f"{folder}/arrays")
    rows = ingest.json_array(spark, f"{folder}/arrays")
    return rows.select("rec", field("doc_id", "long").alias("doc_id"), F.sha2(field("text", "string"), 256).alias("digest"))


@query("SELECT '/ckpt/' || max(event_id) FILTER (WHERE event_id % 100 = 0) AS path FROM events")
def last_checkpoint(spark, d, folder):
    i = F.col("event_id")
    saved = F.concat(F.lit("INFO Saved final checkpoint: /ckpt/"), i.cast("string"), F.lit(" done"))
    table(spark, d, "events").orderBy("event_id").select(F.when(i % 100 == 0, saved).otherwise("step")).write.text(f"{folder}/log")
    return ingest.last_checkpoint(ingest.text_lines(spark, f"{folder}/log"), "line")


@query("""SELECT '# Orders' || chr(10) || chr(10) || '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| orders | ' || count(*) || ' |' || chr(10) || '| customers | ' || count(DISTINCT o_custkey) || ' |' || chr(10) AS markdown,
'{' || chr(10) || '  "orders": ' || count(*) || ',' || chr(10) || '  "customers": ' || count(DISTINCT o_custkey) || chr(10) || '}' || chr(10) AS json FROM orders""")
def report_texts(spark, d, folder):
    made = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return spark.createDataFrame([(sinks.markdown(made, "Orders"), sinks.pretty(made))], "markdown string, json string")
