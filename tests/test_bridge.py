from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.triples import TRIPLE
from graphloom.operators.joins import localize
from graphloom.plans import bridge


def exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_lists_of_documents_are_those_of_the_joins(spark, tiny):
    """Marks on the triples say what joins with the record's graphs would, and items are moved by document and by record alone."""
    triples = bridge.kg_triples(spark, tiny)
    merged = bridge.kg_merged(triples)
    item = F.struct("t_pos", F.struct("h", "r", "t").cast(TRIPLE).alias("x"))
    side = lambda c, of: localize(triples, merged.where(of)).groupBy("rec", "ctx_pos").agg(F.transform(F.array_sort(F.collect_list(item)), lambda y: y["x"]).alias(c))
    both = side("public", "not sampled").join(side("private", "sampled"), ["rec", "ctx_pos"], "full_outer")
    empty = F.array().cast(f"array<{TRIPLE}>")
    want = both.select("rec", "ctx_pos", F.coalesce("public", empty).alias("public"), F.coalesce("private", empty).alias("private"))
    lists = bridge.local_lists(spark, tiny)
    assert sorted(map(repr, lists.collect())) == sorted(map(repr, want.collect()))
    assert exchanges(lists) <= 4  # orders by record, both sides by order, all by record
    columns = ["rec", "ctx_id", "ctx_pos", "t_pos", "h", "r", "t", "pos"]
    _, private, public = bridge.graphs(spark, tiny)
    for got, of in ((private, "sampled"), (public, "not sampled")):
        assert got.columns == columns and sorted(map(repr, got.collect())) == sorted(map(repr, merged.where(of).select(*columns).collect()))


def test_the_tasks_grow_with_the_items(spark, tiny, monkeypatch):
    monkeypatch.setattr(bridge, "ROWS", 100)
    assert bridge.kg_by_record(spark, tiny).rdd.getNumPartitions() == bridge.table(spark, tiny, "lineitem").count() // 100 + 1


def test_marks_are_made_in_few_sorts(spark, tiny):
    """One for the items of an order, one to tell triples apart and find a document's first, two of the graph, one for what it holds."""
    plan = bridge.marked(spark, tiny)._jdf.queryExecution().sparkPlan().toString()
    rows = bridge.marked(spark, tiny)
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_record = [line for line in final.splitlines() if "Sort [rec#" in line and "o_orderkey" not in line and "l_orderkey" not in line]
    assert plan.count("Window") >= 5 and len(by_record) == 4


def test_pairs_are_counted_where_their_record_lies(spark, tiny):
    from graphloom.operators import dedup

    counted = dedup.pair_counters(bridge.kg_by_record(spark, tiny))
    counted.collect()
    final = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    last = [line for line in final.splitlines() if "Exchange" in line][0]
    assert "REPARTITION_BY_NUM" in last  # the dealing out of records is the last move



def test_what_a_value_is_needs_no_look_inside(spark):
    from graphloom.operators import validate

    v = F.col("v")
    assert "schema_of_variant" not in str(validate.is_object(v)) + str(validate.is_list(v, "$.a")) + str(validate.is_there(v, "$.a"))
    texts = ['{"a": [1]}', '{"a": {"b": 1}}', '{"a": null}', "{}", "[1]", "null", '"x"', "1", '{"a": []}', "{"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    got = [tuple(r) for r in rows.select("i", validate.is_object(v), validate.is_list(v, "$.a"), validate.is_there(v, "$.a")).orderBy("i").collect()]
    assert [r[1] for r in got] == [True, True, True, True, False, False, False, False, True, False]
    assert [r[2] for r in got] == [True, False, False, False, False, False, False, False, True, False]
    assert [r[3] for r in got] == [True, True, True, False, False, False, False, False, True, False]
