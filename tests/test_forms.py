from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import triples as T
from graphloom.operators import lineage, models, selection


def test_casefold_is_pythons(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ ς", "İstanbul ı", "ﬁn ŉ ǰ", "Ꭰꭰ", "plain", "", None, "\U00010400x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.casefold(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == {i: None if x is None else x.casefold() for i, x in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 400])
def test_each_side_of_a_split_has_a_row(spark, n):
    rows = selection.hash_split(spark.range(n), F.col("id"), 0.15).groupBy("split").count().collect()
    found = {r["split"]: r["count"] for r in rows}
    assert sum(found.values()) == n
    assert set(found) == (set() if n == 0 else {"train"} if n == 1 else {"train", "validation"})
    if n == 400:
        assert 30 <= found["validation"] <= 90


def test_files_share_one_generator():
    one = random.Random(42)
    want = [one.sample(range(10), 5), one.sample(range(7), 3)]
    assert selection.shared_samples([10, 7], 0.5) == want
    assert selection.shared_samples([10, 7], 0.5, most=6) == [want[0], want[1][:1]]
    assert selection.shared_samples([3, 2], 1.0, most=4) == [[0, 1, 2], [0]]


def test_a_call_that_hangs_is_interrupted(spark):
    def factory():
        def run(texts):
            while "hang" in texts[0]:
                time.sleep(0.05)
            return [x.upper() for x in texts]

        return run

    df = spark.createDataFrame([(0, "fine"), (1, "hang"), (2, None), (3, "after")], "i int, text string").coalesce(1)
    began = time.monotonic()
    got = models.resolve(df, "text", factory, seconds=0.5).orderBy("i").collect()
    assert time.monotonic() - began < 30
    assert [(r["text"], r["timed_out"]) for r in got] == [("FINE", False), ("hang", True), (None, False), ("AFTER", False)]


def test_representatives_stand_as_whole_entities():
    tokens = ["Ada", "Lovelace", "said", "she", "and", "Bob", ",", "they", "met"]
    chains = {3: [0], 7: [1, 5]}
    assert models.resolved_tokens(tokens, [(0, 2)], chains) == " Ada Lovelace said Ada Lovelace and Bob , Ada Lovelace and Bob met"
    assert models.resolved_tokens(tokens, [], {}) == " " + " ".join(tokens)


def test_rules_find_names_with_words_between(spark):
    texts = ["Ada Lovelace worked with Charles Babbage. Paris", "Bob likes Eve likes Dan", "no names here", "", None, "Al is far too far from Bo"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = sorted((r["i"], r["t_pos"], r["h"], r["r"], r["t"]) for r in models.extract(df, "text", ["i"]).collect())
    assert got == [(0, 0, "Ada Lovelace", "worked with", "Charles Babbage"), (1, 0, "Bob", "likes", "Eve"), (1, 1, "Eve", "likes", "Dan")]


def test_scratch_leaves_nothing(spark):
    with lineage.scratch(spark) as folder:
        spark.range(3).write.parquet(f"{folder}/x")
        assert spark.read.parquet(f"{folder}/x").count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
