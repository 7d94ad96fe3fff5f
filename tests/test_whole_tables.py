"""Queries against brute force over whole tables."""

from __future__ import annotations

import hashlib

import pytest

from graphloom.plans import catalogue


def test_qa_pairs_are_those_of_all_customers(spark, tmp_path):
    customers = [(i, i % 4, f"c{i}") for i in range(1, 50)]
    suppliers = [(i % 5, f"s{i}") for i in range(1, 8)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_nationkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["qa_pairs"](spark, str(tmp_path)).collect()))
    assert got == sorted((n, c, s) for i, n, c in customers if i % 9 for m, s in suppliers if n == m)


@pytest.mark.parametrize(("name", "seed", "n"), [("select_unique", 42, 50), ("train_eval_split", 43, 60)])
def test_questions_that_begin_alike_are_different(spark, tmp_path, name, seed, n):
    texts = [f"The same beginning of {'many ' * (i % 3)}texts, number {i // 2}" for i in range(90)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    best = {}
    for i, text in enumerate(texts):
        key = " ".join(text.split()).lower()
        best[key] = min(best.get(key, ("~",)), (hashlib.sha256(f"{seed}\0{key}\0{i}".encode()).hexdigest(), i))
    want = [i for _, i in sorted(best.values())[:n]]
    got = {r["rank"]: r["index"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert [got[i] for i in sorted(got)] == want
