from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import triples as T
from graphloom.plans import forms


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_three_families_round_trip(spark):
    df = spark.createDataFrame([("A b", "knows", "C")], "h string, r string, t string")
    x = F.struct("h", "r", "t")
    for family, tags in T.TAGS.items():
        row = df.select(T.serialize(x, family).alias("s")).select("s", T.parse(F.col("s")).alias("p"), T.canonical(F.col("s")).alias("c")).first()
        assert row.s == f"{tags[0]}A b{tags[1]}knows{tags[2]}C{tags[3]}"
        assert tuple(row.p) == ("A b", "knows", "C")
        assert row.c == "<subj>A b<rel>knows<obj>C<e>"


@pytest.mark.parametrize("text", ["", "<subj>a<rel>b<obj>c", "x<subj>a<rel>b<obj>c<e>", "<subj>a<rel>b<obj>c<e>y", "<subj>a<rel>b<obj>c<e><subj>a<rel>b<obj>c<e>", "<subj> <rel>b<obj>c<e>", "<subj>a<crel>b<obj>c<e>"])
def test_malformed_tagged_strings(spark, text):
    assert one(spark, T.parse(F.col("t")), t=text) is None


def test_white_space_collapses_inside_of_parts(spark):
    assert tuple(one(spark, T.parse(F.col("t")), t="<subj>a\n  b<rel>r\tq<obj>　c<e>")) == ("a b", "r q", "c")


def test_collapse_follows_unicode_white_space(spark):
    spaces = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert one(spark, T.collapse(F.col("t")), t=f"{spaces}a{spaces}b{spaces}") == "a b"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (None, []),
        ("<subj>a<rel>b<obj>c<e>", [("a", "b", "c")]),
        (["a", "b", "c"], [("a", "b", "c")]),
        (["<subj>a<rel>b<obj>c<e>"] * 3, [("a", "b", "c")] * 3),
        ([["a", "b", "c"], "<rsubj>d<rrel>e<robj>f<re>", ["a", "b", "c"]], [("a", "b", "c"), ("d", "e", "f"), ("a", "b", "c")]),
        ([["a", "b"], ["a", " ", "c"], 7], [None, None, None]),
    ],
)
def test_mixed_collections(spark, value, expected):
    got = one(spark, T.normalize_collection(F.parse_json(F.col("t"))), t=json.dumps(value))
    assert [None if x is None else tuple(x) for x in got] == expected


def test_penalty_boundaries(spark):
    steps = {0: 20, 1: 20, 349: 20, 350: 25, 699: 25, 700: 30, 1049: 30, 1050: 35, 1399: 35, 1400: 40, 99999: 40}
    rows = spark.createDataFrame([(k,) for k in steps], "s long").select("s", S.penalty(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in rows} == steps


def test_reward_and_its_limits(spark):
    import math

    assert one(spark, S.reward(F.col("a"), F.col("b"), F.lit(20)), a=0.8, b=0.2) == pytest.approx(0.8 * math.exp(-4))
    assert one(spark, S.reward(F.col("a"), F.col("b"), F.lit(20)), a=1.2, b=0.2) is None
    assert one(spark, S.reward(F.col("a"), F.col("b"), F.lit(20)), a=float("nan"), b=0.2) is None


def test_small_text_functions(spark):
    assert one(spark, S.log_time(F.col("t")), t="2024-01-02 03:04:05,678") == "2024-01-02T03:04:05.678+08:00"
    assert one(spark, S.redact_prefix(F.col("t"), "/a/b"), t="/a/b") == "."
    assert one(spark, S.redact_prefix(F.col("t"), "/a/b"), t="x /a/b/c") == "x c"
    assert one(spark, S.stem(F.col("t"), "_rel"), t="/x/popqa_rel.jsonl") == "popqa"
    assert one(spark, S.same_version(F.col("a"), F.col("b")), a="2.3.1+cu121", b="2.3.1") is True
    assert one(spark, S.is_revision(F.col("t")), t="a" * 40) is True
    assert one(spark, S.is_digest(F.col("t")), t="a" * 63) is False
    assert one(spark, S.as_bool(F.col("t")), t=" Yes ") is True


def test_prompt_variants(spark):
    df = spark.createDataFrame([("T", [("a", "b", "c")], [("d", "e", "f")])], f"text string, pub array<{T.TRIPLE}>, pri array<{T.TRIPLE}>")
    get = lambda *a: df.select(S.prompt(F.col("text"), F.col("pub"), F.col("pri"), *a).alias("p")).first().p
    pub, pri = "<csubj>a<crel>b<cobj>c<ce>", "<rsubj>d<rrel>e<robj>f<re>"
    assert get("rewrite", True) == f"{S.TASK_REWRITE}\n\ntext: T\n\nprivacy triples: {pri}\n\npublic triples: {pub}{S.ANSWER_MARK}"
    assert get("policy", True) == f"{S.TASK_TRAIN}\n\ntext: T\n\nprivate triples: {pri}\n\npublic triples: {pub}{S.ANSWER_MARK}"
    assert get("policy", False) == f"{S.TASK_TRAIN}T{pri}{pub}{S.ANSWER_MARK}"
    assert get("test", True) == f"{S.TASK_REWRITE}text: Tprivacy triples: {pri}public triples: {pub}"


def test_pad_ids(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<long>")
    out, mask = S.pad_ids(F.col("ids"), 5, 9)
    assert df.select(out.alias("o"), mask.alias("m")).first() == ([5, 6, 7, 9, 9], [1, 1, 1, 0, 0])
    out, mask = S.pad_ids(F.col("ids"), 2)
    assert df.select(out.alias("o"), mask.alias("m")).first() == ([5, 6], [1, 1])


def test_a_tagged_string_is_matched_once_and_cut_once(spark):
    rows = spark.createDataFrame([("<rsubj> a <b<rrel>ships \n c<robj>😀 d<re>\n",), ("<rsubj>a<rrel>b<robj>c<robj>d<re>",), ("<rsubj>a<crel>b<robj>c<re>",), (None,)], "s string")
    parsed = rows.select(T.parse(F.col("s")).alias("p"), T.canonical(F.col("s")).alias("c"), T.is_serialized(F.col("s")).alias("k"))
    assert [(r.p and tuple(r.p), r.c, r.k) for r in parsed.collect()] == [(("a <b", "ships c", "😀 d"), "<subj>a <b<rel>ships c<obj>😀 d<e>", True), *[(None, None, False)] * 3]
    plan = rows.select(T.parse(F.col("s")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("regexp_replace(") + plan.count("RLIKE") + plan.count("split(") <= 4


def test_patterns_of_parts_go_by_runs(spark):
    """No look ahead at each character, and the same strings as with one."""
    blanks = T.SPACE_RANGES
    slow = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in blanks) + "]"
    one = rf"(?!{T.ANY_TAG})"
    word = f"(?:{one}[^{slow[1:]})+"
    loose = rf"{slow}*(?:{one}[^{slow[1:]})(?:{one}[\s\S])*"
    canonical = rf"\A<subj>{word}(?: {word})*<rel>{word}(?: {word})*<obj>{word}(?: {word})*<e>\z"
    tagged = rf"\A{slow}*<([cr]?)subj>{loose}<\1rel>{loose}<\1obj>{loose}<\1e>{slow}*\z"
    assert "(?:(?!" not in T.CANONICAL + T.TAGGED
    rng, bits = random.Random(5), ["a", "<", "<e", "<ce>", "<subj>", "<rel>", " ", "  ", "\n", " ", "　", "é", "\U0001f600", "<x>", "~", "!"]
    part = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(1, 3)))
    texts = [f"{rng.choice(['', ' ', 'x'])}<{f}subj>{part()}<{f}rel>{part()}<{f}obj>{part()}<{f}e>{rng.choice(['', '', chr(10)])}" for f in ("", "c", "r") for _ in range(700)]
    x = F.col("x")
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.is_canonical(x), F.regexp_like(x, F.lit(canonical)), T.is_serialized(x), F.regexp_like(x, F.lit(tagged)), T.collapse(x), T.strip(x), F.regexp_replace(x, rf"^{slow}+|{slow}+\z", "")).collect()
    for t, a, b, c, d, collapsed, e, f in rows:
        assert (a, c, e) == (b, d, f) and collapsed == " ".join(t.split()), t
    assert {r[1] for r in rows} == {r[3] for r in rows} == {True, False}


def test_forms_of_odd_texts_are_those_of_their_parts(spark):
    draw, tag = random.Random(3), ["<subj>", "<rel>", "<obj>", "<e>"]
    bits = [*["a", "b c"] * 12, " ", "  ", "\t", "\n", " ", "　", "ß", "\U0001f600", "<", "<<", "<c", "< subj>", "<subj", "e>", "$1", "\\", "\x01", ""]
    part = lambda: "".join(draw.choice(bits) for _ in range(draw.randrange(1, 5)))
    texts = []
    for _ in range(3000):
        family = draw.choice(["", "c", "r"])
        tags = [x.replace("<", f"<{family}") for x in tag]
        if draw.random() < 0.15:
            tags[draw.randrange(4)] = draw.choice(["", "<obj>", "<re>", "<cobj>"])
        ends = draw.choice(["", "", " ", "\n ", "　", "x"]), draw.choice(["", "", " ", "\r\n", "x"])
        texts.append(ends[0] + "".join(x + part() for x in tags[:3]) + tags[3] + ends[1])
    blank = "".join(chr(i) for a, b in T.SPACE_RANGES for i in range(a, b + 1))

    def form(text):
        found = re.fullmatch(f"[{blank}]*<([cr]?)subj>(.*?)<\\1rel>(.*?)<\\1obj>(.*?)<\\1e>[{blank}]*", text, re.S)
        parts = [re.sub(f"[{blank}]+", " ", x).strip(" ") for x in found.groups()[1:]] if found else [""]
        return None if "" in parts or any(re.search(T.ANY_TAG, x) for x in found.groups()[1:]) else "".join(x + y for x, y in zip(tag, [*parts, ""]))

    want = {x: (form(x), form(x) is not None, form(x) == x) for x in texts}
    assert sum(v[1] for v in want.values()) > 500 and sum(v[2] for v in want.values()) > 20
    rows = T.with_forms(spark.createDataFrame([(x,) for x in want] + [(None,)], "text string"), "text")
    more = rows.select("text", "form", "known", "exact", T.serialize(T.parse(F.col("text"))), T.is_serialized(F.col("text")), T.is_canonical(F.col("text"))).collect()
    assert [tuple(r)[1:] for r in more] == [v * 2 for v in want.values()] + [(None, False, False) * 2]


def test_a_text_is_matched_once_for_its_forms(spark, tiny):
    plan = forms.QUERIES["canonical_forms"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"<\1rel>") == 1 and "transform" not in plan
