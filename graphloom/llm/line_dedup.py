"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble.

Only 16-byte hashes travel to the count. A document and the positions that it loses meet in one join
by the document's key, and ``array_except`` on positions puts the rest together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, names_apart, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
#: So many lines at most, of so many documents at least, are met by broadcast.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hash(line: Column, min_chars: int) -> Column:
    """16 bytes for a line that can be dropped, else null."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


def repeated_lines(docs: DataFrame, text_col: str, id_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h, n, last): the hash of each line that n >= ``min_docs`` documents hold, and the largest of their ids."""
    lines = F.split(text_or_empty(text_col), "\n")
    hashes = F.array_distinct(F.array_compact(F.transform(lines, lambda x: line_hash(x, min_chars))))
    counted = docs.select(F.col(id_col).alias("id"), F.explode(hashes).alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    return counted.where(F.col("n") >= min_docs)


@names_apart("n_lines", "n_dropped", "kept_text")
def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped and kept_text.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of
    at least ``min_chars`` code points that at least ``min_docs`` rows hold loses all its lines but
    those of the largest id. Null and empty texts are one empty line, which is too short to drop.
    Rows are documents: rows that repeat an id count each, and all rows with the largest id keep the
    line. A null id is below every other; where all ids are null the lines stay.
    """
    lines, mark = fresh("lines", docs.columns), fresh("mark", docs.columns)
    doc = docs.select(F.col(id_col).alias("id"), F.split(text_or_empty(text_col), "\n").alias(lines), F.unhex(F.md5(text_or_empty(text_col).cast("binary"))).alias(mark))
    where = F.transform(F.col(lines), lambda x: line_hash(x, min_chars))
    rows = doc.select("id", mark, F.posexplode(where).alias("pos", "h")).where("h is not null")
    drop = checkpointed(repeated_lines(docs, text_col, id_col, min_chars, min_docs))
    # The commonest lines are met by broadcast; their rows take keys of their own, which meet nothing, through the shuffle.
    hot = drop.where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(HOT)
    seen = rows.join(F.broadcast(hot.select(F.col("h").alias("hot"), F.col("last").alias("hot_last"))), F.col("h") == F.col("hot"), "left")
    own = F.unhex(F.md5(F.concat("h", F.encode(F.concat_ws(" ", F.col("id").cast("string"), F.col("pos").cast("string")), "UTF-8"))))
    spread = seen.withColumn("k", F.when(F.col("hot").isNull(), F.col("h")).otherwise(own))
    cold = drop.join(F.broadcast(hot.select("h")), "h", "left_anti").select(F.col("h").alias("k"), F.col("last").alias("cold_last"))
    met = spread.join(cold, "k", "left").withColumn("last", F.coalesce("hot_last", "cold_last"))
    lost = met.where(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")))
    # Equal rows lose equal positions, so a set of them serves every copy.
    gone = lost.groupBy("id", mark).agg(F.collect_set("pos").alias("gone")).select(F.col("id").alias("gone_id"), F.col(mark).alias("gone_mark"), "gone")
    both = doc.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col(mark) == F.col("gone_mark")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return both.select(F.col("id").alias(id_col), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
