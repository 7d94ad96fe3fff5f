"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor walks a turn's parts in order. Text is escaped and kept; an image, audio or document part
becomes a placeholder, its reference joins the turn's attachments, and the number of tokens that the
placeholder expands to is added up. Turns are framed by control strings, and the character spans of
assistant texts form the loss mask.

Escaping is reversible: a run ``<``, n backslashes, ``|`` gets one backslash more, so no control
string survives inside a text; unescaping takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NL = "<|im_start|>", "<|im_end|>", "\n"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens of a placeholder: one per image tile of so many pixels a side, per so many milliseconds of audio, so many per document page.
TILE, AUDIO_MS, PAGE_TOKENS = 28, 40, 256

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,ms:long,pages:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape(), and a line break becomes ``<n>``; ``<``, waves, ``n>`` gets one wave more."""
    return escape(F.replace(F.regexp_replace(role, "<(~*)n>", "<$1~n>"), F.lit(NL), F.lit("<n>")))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(unescape(role), F.lit("<n>"), F.lit(NL)), "<(~*)~n>", "<$1n>")


def _units(x: Column, each: int) -> Column:
    return F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(1)) / F.lit(each)).cast("long")


def visit(part: Column) -> Column:
    """(text, ref, tokens) of one part; an unknown kind is read as text."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    holder = F.lit(None).cast("string")
    tokens = F.lit(0).cast("long")
    for name, size in (("image", _units(part["width"], TILE) * _units(part["height"], TILE)), ("audio", _units(part["ms"], AUDIO_MS)), ("document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(1)) * PAGE_TOKENS)):
        holder = F.when(kind == name, F.lit(PLACEHOLDER[name])).otherwise(holder)
        tokens = F.when(kind == name, size).otherwise(tokens)
    return F.struct(
        F.coalesce(holder, escape(F.coalesce(part["text"], F.lit("")))).alias("text"),
        F.when(holder.isNotNull(), F.coalesce(part["ref"], F.lit(""))).alias("ref"),
        tokens.alias("tokens"),
    )


def text_part(text: Column) -> Column:
    """A turn's plain text as its only part."""
    return F.array(F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), text, F.lit("ref"), F.lit(None), F.lit("width"), F.lit(None), F.lit("height"), F.lit(None), F.lit("ms"), F.lit(None), F.lit("pages"), F.lit(None)).cast(PART))


def format_chats(turns: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, trained, spans, attachments, expanded_tokens from (conv_id, turn, role, parts).

    trained: for each turn whether its role is trained on. spans: array of (start, length) in code
    points, one for each of those turns, the turn's text without frame. Turns stand in order of
    ``turn``, ties by role and text, nulls first. A null conv_id is a conversation of its own, a null
    role is empty, null parts are none. The turns of a conversation meet in one row, since its text is
    one value of the result; their places are a running sum over its rows, so the work grows with the
    number of turns and no faster (but for sorting them).
    """
    seen = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), visit)
    turn = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(seen, lambda x: x["text"]), "").alias("text"),
        F.array_compact(F.transform(seen, lambda x: x["ref"])).alias("refs"),
        F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(NL))
    framed = turn.select("*", F.char_length(head).cast("long").alias("head"), F.char_length("text").cast("long").alias("body"), F.concat(head, "text", F.lit(END + NL)).alias("piece"), F.col("role").isin(*train_roles).alias("train"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "refs", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = framed.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0).cast("long")))
    item = F.struct("at", "head", "body", "piece", "train", "refs")
    talk = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("ts"), F.sum("tokens").alias("expanded_tokens"))
    return talk.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("ts", lambda t: t["train"]).alias("trained"),
        F.transform(F.filter("ts", lambda t: t["train"]), lambda t: F.struct((t["at"] + t["head"]).alias("start"), t["body"].alias("length"))).alias("spans"),
        F.flatten(F.transform("ts", lambda t: t["refs"])).alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: role and text, unescaped. One split, one pass over its pieces."""
    raw = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    role = lambda x: F.substring_index(x, NL, 1)
    return F.transform(
        raw,
        lambda x: F.struct(
            unescape_role(role(x)).alias("role"),
            unescape(F.regexp_replace(F.substring(x, F.char_length(role(x)) + 2, F.char_length(x)), r"<\|im_end\|>\n\z", "")).alias("text"),
        ),
    )


def masked(turns: Column, trained: Column) -> Column:
    """Of turns read back, the texts of those trained on, joined."""
    both = F.arrays_zip(turns.alias("t"), trained.alias("on"))
    return F.array_join(F.transform(F.filter(both, lambda z: z["on"]), lambda z: z["t"]["text"]), "")
