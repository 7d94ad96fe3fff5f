"""URL filters as a temporal list join, in DataFrame functions only.

A list is a history: dated entries add a rule to it or take one away. Entries become validity
intervals ``[valid_from, valid_to)``, open where nothing follows; an as-of join evaluates every
capture against the rules that were active when it was fetched.

Rules and captures meet on (key, month). A domain rule's key is its host; a prefix rule's key is its
host and its first ``KEY_DEPTH`` path segments, and an exact test follows for what lies deeper. So a
host with a third of all captures spreads over the months, the rules of a key are few in any of
them, and adaptive skew joins can split what is left: no grouping sits on the captures' side. A rule
stands in the months that have captures and in no others, however long it holds, and a host asks for
as many of its parent domains as the longest domain of the list has labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

KEY_DEPTH = 12


def _bare(url: Column) -> Column:
    """A url from its authority on: no control characters or blanks around it, no tabs or line ends inside, no scheme; backslashes count as slashes."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    ahead = F.regexp_replace(F.regexp_extract(clean, r"^[^?#]*", 0), r"\\", "/")
    return F.regexp_replace(ahead, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//+", "")


def host_of(url: Column) -> Column:
    """Lower-case host without credentials (all up to the last @), port and dots at its end; an IPv6 address in its brackets. Null without a host."""
    authority = F.regexp_replace(F.regexp_extract(_bare(url), r"^[^/]*", 0), r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]+)", 1)), r"\.+\z", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, its segments parted by single slashes, none at its ends."""
    path = F.regexp_replace(_bare(url), r"^[^/]*", "")
    return F.btrim(F.regexp_replace(path, "/+", "/"), F.lit("/"))


def _prefixes(path: Column) -> Column:
    """The first 0, 1, ... ``KEY_DEPTH`` segments."""
    cut = F.substring_index(path, "/", KEY_DEPTH)
    parts = F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, those of at most so many labels."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - (most - 1))
    return F.transform(F.sequence(first, F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def _month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, host, path, category, valid_from, valid_to) from dated entries.

    entries: list, kind ("domain" or "prefix"), pattern (host, or host/path), action ("add" or
    "remove"), category, effective_at. A rule holds from an "add" to the rule's next entry; without one
    valid_to is null and the rule holds on. Of entries at one moment "remove" wins, then the largest category. Entries without a host or a time are not
    used. The next entry is looked up inside a month first and then among the months that have any,
    so a rule with a long history is spread over tasks.
    """
    rule = ["list", "kind", "host", "path"]
    clean = entries.select(
        F.coalesce("list", F.lit("")).alias("list"),
        F.coalesce("kind", F.lit("domain")).alias("kind"),
        host_of(F.col("pattern")).alias("host"),
        F.when(F.coalesce("kind", F.lit("domain")) == "prefix", path_of(F.col("pattern"))).otherwise("").alias("path"),
        (F.coalesce(F.col("action"), F.lit("add")) == "remove").alias("gone"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.col("effective_at").alias("at"),
    ).where("host is not null and at is not null")
    state = clean.groupBy(*rule, "at").agg(F.max(F.struct("gone", "category")).alias("s")).select(*rule, "at", "s.*", _month(F.col("at")).alias("m"))
    firsts = state.groupBy(*rule, "m").agg(F.min("at").alias("first"))
    following = firsts.withColumn("following", F.lead("first").over(Window.partitionBy(*rule).orderBy("m"))).drop("first")
    inside = state.withColumn("within", F.lead("at").over(Window.partitionBy(*rule, "m").orderBy("at")))
    return (
        inside.join(following, [*rule, "m"])
        .where(~F.col("gone"))
        .select(*rule, "category", F.col("at").alias("valid_from"), F.coalesce("within", "following").alias("valid_to"))
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", allow: tuple[str, ...] = ("allow",)) -> DataFrame:
    """``captures`` with n_active, rule, rule_list, category and blocked.

    All rules active at fetch time count. The longest pattern decides, then the later start, then the
    smaller list name; a capture is blocked unless no rule is active or the deciding list is in
    ``allow``. A url without a host, or a capture without a time, meets no rule and is not blocked.
    Repeated captures get the same answer each; an empty list blocks nothing. Where captures have a
    column of a result's name, the result gets a ``_`` before it. What the driver sees is
    the number of labels of the longest domain rule, and the months that have captures.
    """
    inside = {c: f"c{i}" for i, c in enumerate(captures.columns)}
    rows = captures.withColumnsRenamed(inside)
    url, at = F.col(inside[url_col]), F.col(inside[time_col])
    pairs = rows.select(url.alias("u"), at.alias("at")).where("u is not null and at is not null").distinct().select("u", "at", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p")).where("h is not null")
    valid = checkpointed(intervals(entries))
    labels = valid.where("kind <> 'prefix'").agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    months = sorted(r.m for r in captures.select(_month(F.col(time_col)).alias("m")).where("m is not null").distinct().collect())
    held_in = F.split(F.lit(",".join(map(str, months))), ",").try_cast("array<int>")
    domain = F.transform(_suffixes(F.col("h"), labels), lambda x: F.concat(F.lit("d "), x))
    prefix = F.transform(_prefixes(F.col("p")), lambda x: F.concat(F.lit("p "), F.col("h"), F.lit("/"), x))
    asked = pairs.select("u", "at", "p", _month(F.col("at")).alias("m"), F.explode(F.concat(domain, prefix)).alias("key"))
    started, ended = _month(F.col("valid_from")), _month(F.col("valid_to"))
    held = valid.select(
        F.when(F.col("kind") == "prefix", F.concat(F.lit("p "), F.col("host"), F.lit("/"), F.substring_index("path", "/", KEY_DEPTH))).otherwise(F.concat(F.lit("d "), "host")).alias("key"),
        F.explode(F.filter(held_in, lambda m: (m >= started) & (ended.isNull() | (m <= ended)))).alias("m"),
        "list", "category", "valid_from", "valid_to", "path",
        F.when(F.col("kind") == "prefix", F.concat_ws("/", "host", "path")).otherwise(F.col("host")).alias("pattern"),
    )
    deeper = (F.col("path") == "") | F.startswith(F.concat(F.col("p"), F.lit("/")), F.concat(F.col("path"), F.lit("/")))
    hits = asked.join(held, ["key", "m"]).where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))) & deeper)
    best = F.min_by(F.struct("pattern", "list", "category"), F.struct(-F.char_length("pattern"), -F.unix_micros(F.col("valid_from").cast("timestamp")), "list", "category"))
    answers = hits.groupBy("u", "at").agg(F.count("*").alias("n_active"), best.alias("best"))
    joined = rows.join(answers, (url == F.col("u")) & (at == F.col("at")), "left")
    hit = F.col("best.list")
    told = {
        "n_active": F.coalesce("n_active", F.lit(0)).cast("long"),
        "rule": F.col("best.pattern"),
        "rule_list": hit,
        "category": F.col("best.category"),
        "blocked": hit.isNotNull() & ~hit.isin(*allow),
    }
    return joined.select(*(F.col(v).alias(k) for k, v in inside.items()), *(c.alias(fresh(k, captures.columns)) for k, c in told.items()))
