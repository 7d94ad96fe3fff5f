"""Row-local operators on streams.

A record carries its whole graph, so what looks at one record needs no state: the same Column
functions run under Structured Streaming. Here are a stream of JSON lines, the checks and prompts of
its records, and a windowed count of retention with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import prompt
from ..operators.metrics import retention


def json_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Records of JSON-lines files as they arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def prompts(records: DataFrame, kind: str = "rewrite", use_prefix: bool = True) -> DataFrame:
    """One prompt per record of (rec, text, public, private)."""
    return records.select("rec", prompt(F.col("text"), F.col("public"), F.col("private"), kind, use_prefix).alias("prompt"))


def scored(records: DataFrame) -> DataFrame:
    """r_pub and r_pri of (.., predicted, public, private)."""
    p = F.col("predicted")
    return records.withColumn("r_pub", retention(p, F.col("public"), 1.0)).withColumn("r_pri", retention(p, F.col("private"), 0.0))


def windowed_means(rows: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", by: Column | None = None) -> DataFrame:
    """Means of r_pub and r_pri for each window; rows later than the watermark are not counted."""
    keys = [F.window(at, width).alias("window"), *([by.alias("by")] if by is not None else [])]
    return rows.withWatermark(at, late).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r_pub").alias("r_pub"), F.avg("r_pri").alias("r_pri"))


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there now, exactly once, and ends."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
