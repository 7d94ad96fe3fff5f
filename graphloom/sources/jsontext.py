"""JSON arrays of any size, and objects inside of log text, found by their structure.

Text is cut at closing braces wherever they stand. A piece does three things: it may turn "inside of a
string" around (an odd number of quotes), and it changes the depth of brackets by one amount if it
begins outside of a string and by another if inside. Such turns compose like numbers add, so running
sums over pieces, of which one row per file block crosses blocks, tell for every piece where it begins. No task
reads a file whole: elements that end in the piece in which they begin stay where they are, and only the pieces
of the others meet. What several branches read is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed

END = "}"
OPEN, CLOSE = r"[\[{]", r"[\]}]"


def _quotes(piece: Column) -> Column:
    """The number of quotes that open or close a string, escaped ones aside."""
    return F.regexp_count(F.regexp_replace(piece, r"\\[\s\S]", ""), F.lit('"'))


def _depth(piece: Column, inside: bool) -> Column:
    """How far brackets outside of strings lead in, if the piece begins inside of a string or not."""
    bare = F.regexp_replace(F.regexp_replace(piece, r"\\[\s\S]", ""), r'^[^"]*(?:"|$)' if inside else r"^$", "")
    outside = F.regexp_replace(bare, r'"[^"]*(?:"|$)', "")
    return F.regexp_count(outside, F.lit(OPEN)) - F.regexp_count(outside, F.lit(CLOSE))


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all pieces of the file before this one."""
    w = Window.partitionBy("_file", "_block")
    here = rows.withColumn("_value", value.cast("long")).withColumn("_sum", F.coalesce(F.sum("_value").over(w.orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = here.groupBy("_file", "_block").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_earlier"))
    return here.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_sum") + F.col("_earlier")).drop("_value", "_sum", "_earlier")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block, _id (ascending in a block) and piece, without the closing brace at its end; closed tells whether there was one. _top is the file's first character, null if it is blank."""
    read = spark.read.option("lineSep", END).text(path).select(F.col("value").alias("piece"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"))
    rows = read.withColumn("_id", F.monotonically_increasing_id())
    first = F.regexp_extract("piece", "^\ufeff?\\s*(\\S)", 1)
    place = F.struct("_block", "_id")
    ends = rows.groupBy("_file").agg(F.max(place).alias("_last"), (F.sum(F.octet_length("piece") + 1) - F.max("_size")).alias("_over"), F.min_by(F.when(first == "", END).otherwise(first), F.when((first != "") | (F.col("piece") == ""), place)).alias("_top"))
    # All pieces of a file are closed but the last one, unless its brace is the file's last byte (readers leave out a byte order mark, of three bytes).
    # A packed file's size tells nothing: there an array ends without a brace, and anything else with one, blanks aside.
    packed = F.regexp_like("_file", F.lit(r"\.(?:gz|bz2|zst|deflate|snappy|lz4)\z"))
    last = F.when(packed, (F.col("_top") != "[") & ((first != "") | (F.col("piece") == ""))).otherwise(F.col("_over").isin(0, -3))
    return rows.join(F.broadcast(ends), "_file").withColumn("closed", (place != F.col("_last")) | last).drop("_last", "_over", "_size")


def _scanned(pieces: DataFrame) -> DataFrame:
    """The pieces with _inside (of a string), _depth, both where a piece begins, _step (what it adds to the depth, its closing brace too) and _ends (outside of a string)."""
    rows = _running(pieces, _quotes(F.col("piece")), "_quoted").withColumn("_inside", F.col("_quoted") % 2 == 1)
    rows = rows.withColumn("_ends", F.col("closed") & ((F.col("_quoted") + _quotes(F.col("piece"))) % 2 == 0))
    own = F.when(F.col("_inside"), _depth(F.col("piece"), True)).otherwise(_depth(F.col("piece"), False))
    return _running(rows.withColumn("_step", (own - F.when(F.col("_ends"), 1).otherwise(0)).cast("long")), F.col("_step"), "_depth").drop("_quoted")


def _refuse(reason: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{reason}: "), F.col("_file"))).cast("string")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, v): the elements of each file's top-level array in order, from 0, as VARIANT; a lone object is one element.

    Any other top level, and what is no JSON, is an error. An empty or blank file has no element. Files are UTF-8; packed ones are read by a task each.
    """
    rows = checkpointed(_scanned(_pieces(spark, path)))
    totals = rows.groupBy("_file").agg(F.sum("_step").alias("_left"))
    known = rows.where("_top is not null").join(F.broadcast(totals), "_file")
    base = F.when(F.col("_top") == "[", 1).otherwise(0)
    marked = checkpointed(_running(known.withColumn("_ends", F.col("_ends") & (F.col("_depth") + F.col("_step") == base)), F.when(F.col("_ends"), 1).otherwise(0), "_nth"))
    text = F.concat("piece", F.when(F.col("closed"), F.lit(END)).otherwise(F.lit(""))).alias("text")
    keys = ("_file", "_top", "_left", "_nth")
    # An element that began in an earlier piece has this one begin inside of its brackets, or of a string.
    alone = F.col("_ends") & ~F.col("_inside") & (F.col("_depth") <= base)
    whole = marked.where(alone).select(*keys, "_block", "_id", "_ends", text)
    part = F.struct("_block", "_id", text)
    parts = marked.where(~alone).groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("all"), F.max("_ends").alias("_ends"))
    joined = parts.select(*keys, F.element_at("all", -1)["_block"].alias("_block"), F.element_at("all", -1)["_id"].alias("_id"), "_ends", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))
    groups = whole.unionByName(joined)
    lead = F.regexp_extract("text", "^\ufeff?\\s*(\\S)", 1)
    core = F.regexp_replace("text", "^\ufeff?\\s*[\\[,]", "")
    last = F.regexp_replace(F.when(lead == "]", F.col("text")).otherwise(core), r"\]\s*\z", "")
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) == ""
    array = (
        F.when(F.col("_left") != 0, _refuse("brackets without a partner"))
        .when((F.col("_top") == "{") & (F.col("_nth") == 0) & F.col("_ends"), F.regexp_replace("text", "^\ufeff", ""))
        .when((F.col("_top") == "{") & (lead == ""), F.lit(""))
        .when(F.col("_top") != "[", _refuse("neither one JSON array nor one object"))
        .when((F.col("_nth") > 0) & (lead != ",") & (F.col("_ends") | (lead != "]")), _refuse("no comma between elements"))
        .when(~F.col("_ends") & ~F.regexp_like("text", F.lit(r"\]\s*\z")), _refuse("something behind the JSON array"))
        .when(~F.col("_ends") & (lead == ",") & blank(last), _refuse("a comma without an element"))
        .when(F.col("_ends"), core)
        .when(blank(last), F.lit(""))
        .otherwise(last)
    )
    made = checkpointed(groups.select("_file", "_block", "_id", F.variant_get(F.parse_json(F.concat(F.lit("["), array, F.lit("]"))), "$", "array<variant>").alias("array")))
    placed = _running(made, F.size("array"), "_before")
    return placed.select("_file", "_before", F.posexplode("array").alias("_at", "v")).select(F.col("_file").alias("file"), (F.col("_before") + F.col("_at")).alias("element"), "v")


def json_after_marker(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(file, v): of each file the JSON object that begins with the first brace after the first marker, over lines, up to its own closing brace.

    v is null where no object follows; files without the marker have no row.
    """
    rows = _pieces(spark, path).withColumn("_place", F.struct("_block", "_id"))
    found = rows.where(F.contains("piece", F.lit(marker))).groupBy("_file").agg(F.min("_place").alias("_marker"))
    after = rows.join(F.broadcast(found), "_file").where(F.col("_place") >= F.col("_marker"))
    cut = F.expr("substring(piece, locate(%s, piece) + %d)" % ("'" + marker.replace("\\", "\\\\").replace("'", "\\'") + "'", len(marker)))
    after = after.withColumn("piece", F.when(F.col("_place") == F.col("_marker"), cut).otherwise(F.col("piece")))
    opens = after.where(F.contains("piece", F.lit("{"))).groupBy("_file").agg(F.min("_place").alias("_open"))
    held = after.join(F.broadcast(opens), "_file").where(F.col("_place") >= F.col("_open"))
    held = held.withColumn("piece", F.when(F.col("_place") == F.col("_open"), F.expr("substring(piece, locate('{', piece))")).otherwise(F.col("piece")))
    scanned = checkpointed(_scanned(held))
    ends = scanned.where(F.col("_ends") & (F.col("_depth") + F.col("_step") == 0)).groupBy("_file").agg(F.min("_place").alias("_end"))
    mine = scanned.join(F.broadcast(ends), "_file").where(F.col("_place") <= F.col("_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.concat("piece", F.lit(END)).alias("t")))), lambda x: x["t"]), "")
    objects = mine.groupBy("_file").agg(F.try_parse_json(text).alias("v"))
    return found.join(objects, "_file", "left").select(F.col("_file").alias("file"), "v")


def json_after(text: Column, marker: str) -> Column:
    """The JSON object that begins with the first brace after the first marker of a text, up to its own closing brace, as VARIANT; else null."""
    behind = F.substring_index(F.concat(text, F.lit(marker)), marker, 1)
    rest = F.substring(text, F.char_length(behind) + len(marker) + 1, F.char_length(text))
    pieces = F.split(F.substring(rest, F.greatest(F.locate("{", rest), F.lit(1)), F.char_length(rest)), r"\}", -1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        inside = a["inside"] != (_quotes(piece) % 2 == 1)
        depth = a["depth"] + F.when(a["inside"], _depth(piece, True)).otherwise(_depth(piece, False)) - F.when(inside, 0).otherwise(1)
        return F.when(a["done"], a).otherwise(F.struct((a["n"] + 1).alias("n"), depth.alias("depth"), inside.alias("inside"), (~inside & (depth == 0)).alias("done")))

    end = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)
    return F.when(F.contains(text, F.lit(marker)) & F.contains(rest, F.lit("{")) & end["done"], F.try_parse_json(F.concat(F.array_join(F.slice(pieces, 1, end["n"]), END), F.lit(END))))
