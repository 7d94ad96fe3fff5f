from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, line_dedup, ngram_join, simhash

DDL = "doc_id long, text string, lang string, hash long, maybe string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], DDL).repartition(3)


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = min(known) if known else None, hashlib.sha256(text.encode()).hexdigest()
        done = False
        for i in ids:
            first = i == keep and not done
            done = done or first
            out.append((i, keep, len(ids), first, sha))
    return sorted(out, key=repr)


CASES = [
    [],
    [(1, None)],
    [(1, ""), (2, None), (3, " "), (4, "\t\n")],
    [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, "a b "), (8, " a b")],
    [(1, "x"), (1, "x"), (1, "x"), (2, "x"), (2, "y")],
    [(None, "x"), (None, "x"), (4, "x"), (None, "z"), (None, "z")],
    [(1, "long " * 200_000), (2, "long\n" * 200_000), (3, "é b"), (4, "é b")],
]


@pytest.mark.parametrize("rows", CASES)
def test_exact_dedup_cases(spark, rows):
    got = exact_dedup.exact_dedup(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact(rows)


@pytest.mark.parametrize("rows", CASES)
def test_keep_first_copies_keeps_columns_and_one_row_a_group(spark, rows):
    df = docs(spark, rows)
    kept = exact_dedup.keep_first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in plain_exact(rows) if x[3]), key=repr)


@pytest.mark.parametrize("rows", CASES)
def test_cases_in_slices(spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", 1)
    monkeypatch.setattr(exact_dedup, "SLICE_CELLS", 64)
    test_exact_dedup_cases(spark, rows)
    test_keep_first_copies_keeps_columns_and_one_row_a_group(spark, rows)


def test_rows_that_share_text_and_id_but_not_the_rest(spark):
    """Of a thousand such rows one whole row stays, however they are dealt."""
    rows = [(1, "same", str(i % 7), i, None, None) for i in range(1000)] + [(2, "same", "x", 0, None, None), (3, "other", "y", 0, None, None)]
    df = spark.createDataFrame(rows, DDL)
    for n in (1, 5):
        kept = exact_dedup.keep_first_copies(df.repartition(n)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(1, "same"), (3, "other")] and all(tuple(r) in rows for r in kept)


def test_many_slices_and_hot_groups_stay_exact(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "hot") for i in range(1500)] + [(i, f"t{rng.randrange(2500)}") for i in range(1500, 5000)]
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", 2500)
    monkeypatch.setattr(exact_dedup, "SLICE_CELLS", 1024)
    got = exact_dedup.exact_dedup(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact(rows)


def test_no_text_moves_to_be_judged(spark, monkeypatch):
    """Beyond one filter, too, rows are flagged where they are; hashes alone go through slices."""
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    for limit in (1 << 20, 500):
        monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", limit)
        flagged = exact_dedup.flag_possibly_repeated(df, "h", "flag")
        assert "Exchange" not in flagged._jdf.queryExecution().executedPlan().toString()
        sure = {r.doc_id for r in flagged.where("not flag").collect()}
        assert sure <= set(range(100, 900)) and len(sure) > (700 if limit > 500 else 50)


@pytest.mark.parametrize(
    ("operator", "name"),
    [(exact_dedup.exact_dedup, "kept"), (line_dedup.line_dedup, "n_lines"), (simhash.near_duplicates, "fingerprint"), (ngram_join.jaccard_classes, "component_id")],
)
def test_ids_named_like_results(spark, operator, name):
    df = spark.createDataFrame([(2, "a b c d"), (1, "a b c d")], f"{name} long, text string")
    plain = operator(df.withColumnRenamed(name, "doc_id"))
    got = operator(df, id_col=name)
    assert got.columns == [name, *("_" + c if c == name else c for c in plain.columns[1:])]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def plain_lines(rows, least=3, chars=20):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if last.get(key(x)) is None or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


A, B = "This line is shared by all", "é" * 20


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, "\n")],
        [(1, A), (2, f" {A.upper()}\r"), (3, f"x\n{A}\n{A}\ny"), (4, "short\nshort"), (5, "short")],
        [(1, B), (2, B), (3, B), (4, "É" * 20), (5, "é" * 19), (6, "é" * 19), (7, "é" * 19)],
        [(1, A), (1, A), (1, A), (2, f"{A}\nz")],
        [(None, A), (None, A), (None, A), (None, f"{A} b"), (1, f"{A} b"), (2, f"{A} b")],
        [(1, f"{A}\n" * 5000), (2, A), (3, A)],
        [(1, " " + A), (2, A), (3, A), (4, A)],
    ],
)
def test_line_dedup_cases(spark, rows):
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, lines string, mark long").repartition(3)
    got = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == plain_lines(rows)


def test_line_dedup_at_random_with_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rng = random.Random(6)
    pool = [f"{A} number {k}" for k in range(15)]
    rows = [(i, "\n".join([A, *(rng.choice([*pool, "no", f"only here {i} {rng.random()}"]) for _ in range(rng.randint(0, 6)))])) for i in range(150)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == plain_lines(rows)
