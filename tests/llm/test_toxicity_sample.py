from __future__ import annotations

import random

import pytest

from graphloom.llm import toxicity as X


@pytest.mark.parametrize("long", [1_500, 19_990, 30_000])
def test_long_texts_do_not_end_the_learning_of_a_class(spark, monkeypatch, long):
    """Texts of ``long`` characters in the first files; budgets and texts are a small copy of the real ones."""
    rng = random.Random(5)
    ids = [i for i, r in enumerate(spark.range(400).select(X.learned_rows("id").alias("l")).collect()) if r.l]
    texts = {i: " ".join(rng.choice(["ba", "do", "ri", "mu"]) for _ in range(rng.randint(5, 30))) for i in ids}
    texts |= {i: ("x" * 9 + " ") * (long // 10) for i in ids[:12]}
    label = {i: i % 2 for i in ids}
    seen = {}
    monkeypatch.setattr(X, "SAMPLE_CHARS", 20_000)
    monkeypatch.setattr(X, "fit", lambda toxic, ordinary, prior: seen.update({1: toxic, 0: ordinary}))
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartitionByRange(4, "doc_id")
    X.train(docs, spark.createDataFrame(list(label.items()), "doc_id long, toxic int"))
    for y in (0, 1):
        short = [texts[i] for i in ids[12:] if label[i] == y]
        assert set(short) <= set(seen[y]) and len(seen[y]) >= len(short)
        assert sum(map(len, seen[y])) <= 20_000


def test_sample_is_in_the_order_of_the_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = {}
    monkeypatch.setattr(X, "fit", lambda toxic, ordinary, prior: seen.update({1: toxic, 0: ordinary}))
    monkeypatch.setattr(X, "SAMPLE_CHARS", 400)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("text")).repartition(5)
    X.train(docs, spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")))
    order = [r.doc_id for r in docs.where(X.learned_rows()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for y in (0, 1):
        assert seen[y] == [f"{i:010d}" for i in order if i % 2 == y][:40]
