"""Triples as structs <h, r, t> and as tagged strings, with Column functions only.

A triple's parts are non-empty, hold no tag, and have runs of white space written as one space.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data format: the tag families of tagged strings.
TAGS = {
    "neutral": ("<subj>", "<rel>", "<obj>", "<e>"),
    "public": ("<csubj>", "<crel>", "<cobj>", "<ce>"),
    "private": ("<rsubj>", "<rrel>", "<robj>", "<re>"),
}
TRIPLE = "struct<h:string,r:string,t:string>"
#: All that Unicode calls white space, where Java's own class has ASCII only: ranges of code points.
SPACE_RANGES = ((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_BLANKS = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SPACE_RANGES)
#: Both classes ask for the visible ASCII characters first, so most characters need one comparison, not one for each range.
SPACE = rf"[[^!-~]&&[{_BLANKS}]]"
NO_SPACE = rf"[!-~[^{_BLANKS}]]"
ANY_TAG = "<[cr]?(?:subj|rel|obj|e)>"
#: What starts with a tag's first character and is no tag.
_BARE = f"<(?!{ANY_TAG[1:]})"
#: What most parts are written with: visible ASCII characters but a tag's first. Patterns ask for these in plain runs, for all others after them.
_PLAIN = "[!-;=-~]"
_VISIBLE = f"[{NO_SPACE}&&[^<]]"
#: A part as it is written in canonical form: words with single spaces between, no tag inside.
_WORD = f"(?>{_PLAIN}++|{_VISIBLE}|{_BARE})(?:{_PLAIN}++|{_VISIBLE}|{_BARE})*+"
PART = f"{_WORD}(?: {_WORD})*+"
CANONICAL = rf"\A<subj>({PART})<rel>({PART})<obj>({PART})<e>\z"
#: A part as it may be written: no tag inside and not blank. No step goes back, so a text is matched in one pass.
LOOSE = f"(?> *+{_PLAIN}|{SPACE}*+(?:{_VISIBLE}|{_BARE}))[^<]*+(?:{_BARE}[^<]*+)*+"
TAGGED = rf"\A{SPACE}*+<([cr]?)subj>{LOOSE}<\1rel>{LOOSE}<\1obj>{LOOSE}<\1e>{SPACE}*+\z"
#: A text that blanks() certainly leaves as it is.
EVEN = r"\A ?(?:[!-~]++ ?)*+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}++|{SPACE}++\z", "")


def blanks(text: Column) -> Column:
    """Runs of white space as one space: first all as blanks, then the few runs that are longer than one."""
    return F.regexp_replace(F.regexp_replace(text, f"[[^ -~]&&{SPACE}]", " "), " {2,}", " ")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(blanks(text))


@cache
def _folds() -> dict[str, str]:
    """Lower-case characters that case folding changes, with what they become."""
    low = {c for x in map(chr, range(sys.maxunicode + 1)) for c in x.lower()} | {"\u03c2"}
    return {c: c.casefold() for c in sorted(low) if c.casefold() != c}


def _class(chars: Iterable[str]) -> Column:
    """The characters as ranges; what most texts are written with is told by two comparisons."""
    ranges: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if ranges and i == ranges[-1][1] + 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    named = [rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges]
    return F.lit(rf"[[\x{{b5}}\x{{149}}-\x{{10ffff}}]&&[{''.join(named)}]]")


def casefold(text: Column) -> Column:
    """Full case folding: lower case, then what folding changes beyond it, in texts that hold such a character.

    Characters that become one other are translated together, the few that become several are replaced
    one by one, the sharp s, which is common, ahead of the others.
    """
    folds, sharp = _folds(), "\u00df"
    single = {c: f for c, f in folds.items() if len(f) == 1}
    several = {c: f for c, f in folds.items() if len(f) > 1 and c != sharp}
    low = F.replace(F.lower(text), F.lit(sharp), F.lit(folds[sharp]))
    moved = F.translate(low, "".join(single), "".join(single.values()))
    whole = moved
    for c, f in several.items():
        whole = F.replace(whole, F.lit(c), F.lit(f))
    return F.when(~F.regexp_like(low, _class({*single, *several})), low).when(F.regexp_like(low, _class(several)), whole).otherwise(moved)


def question_key(text: Column) -> Column:
    """Case and white space do not tell questions apart."""
    return casefold(collapse(text))


def part_ok(text: Column) -> Column:
    return text.isNotNull() & (collapse(text) != "") & ~F.regexp_like(text, F.lit(ANY_TAG))


def triple(h: Column, r: Column, t: Column) -> Column:
    return F.struct(h.alias("h"), r.alias("r"), t.alias("t"))


def coerce(parts: Column) -> Column:
    """A raw triple, an array of exactly three strings, as struct; null if malformed."""
    at = lambda i: F.get(parts, F.lit(i))
    raw = triple(*(at(i) for i in range(3)))
    good = part_ok(at(0)) & part_ok(at(1)) & part_ok(at(2))
    # Nearly all parts are canonical already, which one match tells.
    return F.when(F.size(parts) == 3, F.when(F.regexp_like(serialize(raw), F.lit(CANONICAL)), raw).when(good, triple(*(collapse(at(i)) for i in range(3)))))


def serialize(x: Column, family: str = "neutral") -> Column:
    a, b, c, d = TAGS[family]
    return F.concat(F.lit(a), x["h"], F.lit(b), x["r"], F.lit(c), x["t"], F.lit(d))


def is_canonical(text: Column) -> Column:
    """Whether a string is the neutral form of a triple, to the letter."""
    return F.coalesce(F.regexp_like(text, F.lit(CANONICAL)), F.lit(False))


def parse(text: Column) -> Column:
    """The struct of a tagged string of any family; null if it is not exactly one well-formed triple.

    Parts hold no tag, so a good text has one reading: it is matched once and cut at its tags, and the pieces
    are bound once.
    """
    pieces = F.split(blanks(text), f" ?{ANY_TAG} ?", -1)
    cut = F.when(F.regexp_like(text, F.lit(TAGGED)), F.array(pieces))
    return F.get(F.transform(cut, lambda p: triple(*(F.get(p, F.lit(i)) for i in (1, 2, 3)))), F.lit(0))


def is_serialized(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(TAGGED)), F.lit(False))


def canonical(text: Column) -> Column:
    """The neutral form of a tagged string of any family; null if malformed.

    A well-formed text has its four tags and no other, so they are renamed where they stand; most texts have
    no white space to make even, and one that is canonical stays as it is.
    """
    even = F.when(F.regexp_like(text, F.lit(EVEN)), text).otherwise(blanks(text))
    return F.when(F.regexp_like(text, F.lit(CANONICAL)), text).when(F.regexp_like(text, F.lit(TAGGED)), F.regexp_replace(even, " ?<[cr]?(subj|rel|obj|e)> ?", "<$1>"))


def with_forms(rows: DataFrame, text: str) -> DataFrame:
    """Adds form, known and exact: what canonical(), is_serialized() and is_canonical() give of a text column.

    A text has a form if it is well-formed, and is canonical if it is its own form, so it is matched once for all three.
    """
    made = rows.withColumn("form", canonical(F.col(text)))
    return made.withColumn("known", F.col("form").isNotNull()).withColumn("exact", F.coalesce(F.col("form") == F.col(text), F.lit(False)))


def serialize_all(items: Column, family: str = "neutral") -> Column:
    """The strings of an array of triples, one after the other."""
    return F.array_join(F.transform(items, lambda x: serialize(x, family)), "")


def normalize_collection(value: Column) -> Column:
    """An array of structs from a VARIANT collection of raw and tagged triples, duplicates kept.

    Null is the empty collection, one tagged string or one raw triple a collection of one; three
    strings are one raw triple unless all of them are tagged. A malformed item gives a null element.
    """
    strings = F.try_variant_get(value, "$", "array<string>")
    kinds = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v))
    items = F.try_variant_get(value, "$", "array<variant>")
    whole = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    flat = (F.size(strings) == 3) & F.forall(kinds, lambda k: k == "STRING") & ~F.forall(strings, is_serialized)
    each = F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", parse(F.try_variant_get(v, "$", "string"))).when(F.schema_of_variant(v) == "ARRAY<STRING>", coerce(F.try_variant_get(v, "$", "array<string>"))),
    )
    empty = F.array().cast(f"array<{TRIPLE}>")
    return F.when(value.isNull() | F.is_variant_null(value), empty).when(kind == "STRING", F.array(parse(whole))).when(flat, F.array(coerce(strings))).when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(each, empty))
