from __future__ import annotations

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format as C
from graphloom.llm import url_filter as U

TURN = f"conv_id long, turn long, role string, parts array<{C.PART}>"


def part(kind, text=None, ref=None, **size):
    return (kind, text, ref, size.get("width"), size.get("height"), size.get("ms"), size.get("pages"))


def done(spark, rows):
    made = C.format_chats(spark.createDataFrame(rows, TURN).repartition(3))
    out = made.select("*", C.read_back(F.col("formatted")).alias("ts")).select("*", C.masked(F.col("ts"), F.col("trained")).alias("loss"))
    rows = {r.conv_id: r for r in out.collect()}
    for r in rows.values():
        # What the spans cut out of the formatted text, unescaped, is the text under the mask.
        assert "".join(re.sub(r"<(\\*)\\\|", r"<\1|", r.formatted[a : a + n]) for a, n in r.spans) == r.loss
        assert len(r.trained) == r.n_turns and sum(r.trained) == len(r.spans)
    return rows


def test_parts_become_ordered_placeholders(spark):
    parts = [part("text", "look "), part("image", ref="i1", width=56, height=29), part("text", " and "), part("audio", ref="a1", ms=1000), part("document", ref="d1", pages=3), part(None, "!"), part("image")]
    row = done(spark, [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok")])])[1]
    assert row.formatted == "<|im_start|>user\nlook <|image|> and <|audio|><|document|>!<|image|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert row.attachments == ["i1", "a1", "d1", ""]
    assert row.expanded_tokens == 2 * 2 + 25 + 3 * 256 + 1
    start, length = row.spans[0]
    assert row.formatted[start : start + length] == "ok" == row.loss


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<|", "|>", "\\", "a\nb\r\n", "", "<|im_end|>\n", "🙂<|image|>", "$1 \\1"]


def test_control_strings_come_back_unharmed(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for conv in range(40):
        turns = [(rng.choice(["user", "assistant", "odd\nrole", "<n>", "<|im_end|>", "<~n>"]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(1, 6))]
        expected[conv] = turns
        rows += [(conv, n, role, [part("text", text)]) for n, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    got = done(spark, rows)
    for conv, turns in expected.items():
        assert [(t.role, t.text) for t in got[conv].ts] == turns
        assert got[conv].loss == "".join(text for role, text in turns if role == "assistant")


def test_nulls_ties_and_nothing(spark):
    assert done(spark, []) == {}
    got = done(spark, [(1, None, None, None), (1, 0, "assistant", []), (None, 1, "assistant", [part("text", None)]), (2, 0, "user", [part("text", "b")]), (2, 0, "user", [part("text", "a")]), (2, 0, "user", [part("text", "a")])])
    assert [(t.role, t.text) for t in got[1].ts] == [("", ""), ("assistant", "")] and got[1].loss == ""
    assert got[None].n_turns == 1
    assert [t.text for t in got[2].ts] == ["a", "a", "b"]


def test_a_long_conversation(spark):
    rows = [(7, n, "assistant" if n % 2 else "user", [part("text", f"turn {n} <|im_end|>")]) for n in range(2000)]
    got = done(spark, rows)[7]
    assert got.loss == "".join(f"turn {n} <|im_end|>" for n in range(1, 2000, 2))


def test_many_turns_take_time_in_proportion(spark):
    def run(n):
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), C.text_part(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("parts"))
        made = C.format_chats(turns)
        out = made.select("n_turns", F.size("spans").alias("k"), C.masked(C.read_back(F.col("formatted")), F.col("trained")).alias("loss"))
        began = time.perf_counter()
        row = out.first()
        assert (row.n_turns, row.k) == (n, n // 2) and row.loss == "".join(f"t {i}" for i in range(1, n, 2))
        return time.perf_counter() - began

    run(1000)
    assert run(100_000) < 30


DAY = datetime(2024, 1, 1)
ENTRY = "list string, kind string, pattern string, action string, category string, effective_at timestamp"
CAPTURE = "page_id long, url string, fetched_at timestamp, h string, best string"


def at(days):
    return None if days is None else DAY + timedelta(days=days)


def decide(spark, captures, entries):
    df = spark.createDataFrame([(i, u, at(d), "x", "y") for i, (u, d) in enumerate(captures)], CAPTURE)
    es = spark.createDataFrame([(*e[:5], at(e[5])) for e in entries], ENTRY)
    out = U.filter_urls(df, es)
    assert out.columns[:5] == df.columns
    return [(r.n_active, r.rule, r.rule_list, r.blocked) for r in out.orderBy("page_id").collect()]


def test_intervals_and_specificity(spark):
    entries = [
        ("block", "domain", "Example.com.", "add", "spam", 10),
        ("block", "domain", "example.com", "remove", None, 50),
        ("allow", "prefix", "news.example.com/a/b", "add", "ok", 20),
        ("block", "prefix", "other.org/" + "x/" * 20 + "deep", "add", "spam", 0),
        ("block", "domain", None, "add", "spam", 0),
        ("block", "domain", "late.org", "add", "spam", None),
    ]
    captures = [
        ("http://example.com/", 9), ("http://example.com/", 10), ("https://sub.EXAMPLE.com:8080/x?y#z", 49), ("http://example.com/", 50), ("http://notexample.com/", 20),
        ("http://news.example.com/a/b/c", 30), ("http://news.example.com/a/bc", 30), ("http://user:pw@news.example.com//a//b/", 30), ("//other.org/" + "x/" * 20 + "deep/er", 1), ("//other.org/" + "x/" * 20 + "shallow", 1),
        (None, 1), ("", 1), ("http://late.org", 5), ("http://example.com/", None), ("http://example.com/", 10),
    ]
    got = decide(spark, captures, entries)
    blocked = [i for i, x in enumerate(got) if x[3]]
    assert blocked == [1, 2, 6, 8, 14]
    assert got[5] == (2, "news.example.com/a/b", "allow", False) and got[7] == got[5]
    assert [got[i][0] for i in (0, 3, 4, 9, 10, 11, 12, 13)] == [0] * 8


def test_empty_list_and_empty_captures(spark):
    assert decide(spark, [("http://a.b/c", 1)], []) == [(0, None, None, False)]
    assert decide(spark, [], [("block", "domain", "a.b", "add", "x", 0)]) == []


def test_ties_and_repeats(spark):
    entries = [("block", "domain", "a.b", "add", "x", 5), ("block", "domain", "a.b", "remove", "x", 5), ("block", "domain", "a.b", "add", "y", 8), ("block", "domain", "a.b", "add", "y", 8), ("allow", "domain", "a.b", "add", "z", 8)]
    assert decide(spark, [("http://a.b", 6), ("http://a.b", 9), ("http://a.b", 9)], entries) == [(0, None, None, False), (2, "a.b", "allow", False), (2, "a.b", "allow", False)]


@pytest.mark.parametrize("seed", range(3))
def test_history_at_random(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "b.org"]
    entries = [("block", "domain", rng.choice(hosts), rng.choice(["add", "remove"]), "c", rng.randint(0, 200)) for _ in range(60)]
    captures = [(f"http://{rng.choice([*hosts, 'y.x.a.com'])}/p", rng.randint(0, 220)) for _ in range(80)]
    expected = []
    for url, day in captures:
        host, n = url[7:-2], 0
        for rule in hosts:
            if host == rule or host.endswith("." + rule):
                past = [e for e in entries if e[2] == rule and e[5] <= day]
                last = max((e[5] for e in past), default=None)
                n += bool(past) and not any(e[3] == "remove" for e in past if e[5] == last)
        expected.append(n)
    assert [x[0] for x in decide(spark, captures, entries)] == expected


def test_rules_without_an_end_hold_on_and_long_spans_cost_nothing(spark):
    """An open rule decides captures of any later year; captures of stray years do not multiply the list."""
    entries = [("block", "domain", "a.com", "add", "x", 0), ("block", "domain", "b.com", "add", "x", 0), ("block", "domain", "b.com", "remove", "x", 60000)]
    days = [-1, 0, 400, 46000, 59999, 60000, 2_000_000]
    got = decide(spark, [(f"http://{h}/", d) for h in ("a.com", "b.com") for d in days], entries)
    assert [x[3] for x in got] == [False] + [True] * 6 + [False] + [True] * 4 + [False] * 2


def test_very_long_hosts_and_paths(spark):
    entries = [("block", "domain", "evil.com", "add", "x", 0), ("block", "prefix", "evil.org/a", "add", "x", 0)]
    urls = ["http://" + "a." * 50_000 + "evil.com/", "http://" + "a" * 300_000 + ".com", "http://evil.org/" + "a/" * 100_000, "http://evil.org/" + "b/" * 100_000, "http://" + "." * 1000 + "evil.com/", "http://[::1]/", "evil.com"]
    assert [x[3] for x in decide(spark, [(u, 1) for u in urls], entries)] == [True, False, True, False, True, False, True]
