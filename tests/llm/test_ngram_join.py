from __future__ import annotations

import random
import re

import numpy as np
import pytest

from graphloom.llm import ngram_join


def plain_set(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_classes(rows, percent=90):
    """Of each row its set's size and the smallest id that links reach."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((key, len(sets[i]), (min(ids) if ids else None) if sets[i] else key))
    return sorted(out, key=repr)


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, s string, sketch binary").repartition(3)
    got = ngram_join.jaccard_classes(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \n\t"), (2, "")],
        [(5, "A b"), (3, "a\tB"), (9, "a b c"), (2, "a"), (4, "a"), (7, "É b c"), (8, "é b c"), (6, "a\x1cb")],
        [(4, "x y z q"), (4, "x y z q"), (None, "x y z q"), (None, "only null here"), (None, None), (1, "x y z q r s")],
        [(1, LONG), (2, LONG + " end"), (3, "start " + LONG), (4, "word1 " * 50_000), (5, "WORD1 " * 3)],
    ],
)
def test_cases(spark, rows):
    assert joined(spark, rows) == plain_classes(rows)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("seed", "tile"), [(1, 1024), (2, 8)])
def test_against_all_pairs(spark, monkeypatch, seed, tile):
    """Near copies at all distances around the threshold, common passages, sizes around each other; chunks too."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 90, 200, 700]))]
        rows.extend((rng.randrange(10**6), " ".join(edited(rng, base, rng.randrange(0, 2 + len(base) // 40)))) for _ in range(25))
        rows.extend((rng.randrange(10**6), " ".join([*base[: rng.randrange(len(base))], *passage])) for _ in range(4))
    assert joined(spark, rows) == plain_classes(rows)
    if tile > 8:
        assert joined(spark, rows[:120], percent=60) == plain_classes(rows[:120], 60)


def test_failed_pairs_are_followed_by_others(spark):
    """Sketches of 128 bits for large sets let many pairs through that fail; the buckets are asked until nothing is left."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([5, 10, 16, 20, 40])))) for i in range(60)]
    assert joined(spark, rows, bits=(128, 128)) == plain_classes(rows)


def test_no_pair_within_a_group_is_made(spark):
    """A large group of near copies proposes a forest, not its pairs."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = ngram_join.describe(df, "text", "doc_id", 3, 90).drop("id").dropDuplicates(["s"]).cache()
    met = ngram_join.near_in_size(ngram_join.postings(nodes, nodes), 90)
    asked = ngram_join.proposals(ngram_join.members(met, nodes).selectExpr("*", "s AS comp"), 90)
    assert asked.groupBy("token", "i", "j").count().agg({"count": "max"}).first()[0] < 400
    assert joined(spark, rows) == [(i, 299, 0) for i in sorted(range(400), key=lambda i: repr((i, 299, 0)))]


def test_spanning_forest_takes_the_first_edges():
    x, y = np.array([0, 2, 0, 1, 3]), np.array([1, 3, 2, 3, 0])
    assert sorted(ngram_join.spanning(np.arange(5), x, y)) == [0, 1, 2]
    assert len(ngram_join.spanning(np.zeros(4, int), x[:0], y[:0])) == 0
