from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, the siblings of each leaf on its way up) of digests; all by pairs, level by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            proofs[k].append((run[0] if i % 2 else "", run[1] if i % 2 == 0 and len(run) == 2 else ""))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def plain_manifest(rows):
    """rows: (id, lang, text, claimed text)."""
    own = lambda i, g, t: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, g, t)))
    first = lambda x: (x is not None, x if x is not None else 0)
    trees = []
    for g in sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(((first(i), own(i, g, t), own(i, g, c), i) for i, h, t, c in rows if h == g), key=lambda x: x[:3])
        trees.append((mine, *plain_tree([x[1] for x in mine])))
    root, tops = plain_tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (mine, subroot, proofs), top in zip(trees, tops, strict=True):
        for (_, leaf, claim, i), proof in zip(mine, proofs, strict=True):
            folded = claim
            for a, b in [*proof, *top]:
                folded = sha(a + folded + b)
            out.append((i, leaf, subroot, root, sha("".join(a + b for a, b in [*proof, *top])), folded, folded == root))
    return sorted(out, key=repr)


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, claimed string, leaf string, mark int").repartition(3)
    leaf, claim = (merkle.record_digest([F.col(c) for c in ("doc_id", "lang", t)]) for t in ("text", "claimed"))
    got = merkle.manifest(df, leaf, claim, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def table(seed, n, langs):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "tëxt", "word " * rng.randrange(40)])
        rows.append((rng.choice([None, rng.randrange(n), rng.randrange(n)]), rng.choice(langs), text, "other" if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(7, "en", "one", "one")],
        [(None, None, None, None)],
        [(1, "en", "a", "a"), (1, "en", "a", "a"), (1, "en", "a", "b"), (2, None, "", ""), (3, "", "long " * 100_000, None)],
        table(1, 150, [None, "", "de", "en", "en", "en", "en", "\ue000", "\U0001f600", "EN"]),
    ],
)
def test_against_plain_trees(spark, rows):
    assert made(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("depth", [1, 3])
def test_many_supersteps(spark, depth):
    """Blocks of two and of eight places: roots pass through several supersteps, groups end in different ones."""
    rows = table(2, 90 if depth == 1 else 300, ["en", "en", "en", "en", "de", None]) + [(5, f"x{i}", "t", "t") for i in range(11)]
    assert made(spark, rows, depth=depth) == plain_manifest(rows)


def test_tampering_shows_in_its_own_row_alone(spark):
    rows = [(i, "en", "t", "u" if i == 3 else "t") for i in range(20)]
    assert {r[0] for r in made(spark, rows) if not r[-1]} == {3}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "en"), (2, "en")], "leaf long, lang string")
    got = merkle.manifest(df, merkle.record_digest([F.col("leaf")]), id_col="leaf")
    assert got.columns == ["leaf", "_leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((r.leaf, r.verified) for r in got.collect()) == [(1, True), (2, True)]
