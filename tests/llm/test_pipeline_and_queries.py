from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.llm import exact_dedup, queries, simhash


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in os.listdir(tiny):
            con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{tiny}/{t}'")
        cur = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash", "packing"]
    calm = P.drop_toxic(spark, docs, tiny)
    single = P.drop_copies(spark, calm, tiny)
    far = P.drop_near_copies(spark, single, tiny)
    assert docs.columns == calm.columns == single.columns == far.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(single) == {r.doc_id for r in exact_dedup.exact_dedup(calm).where("kept").collect()}
    assert ids(far) == {r.component_id for r in simhash.near_duplicates(single).collect()}
    packed = P.run(spark, tiny)
    assert ids(packed) == ids(far)
    assert packed.selectExpr("sum(length) as n").first().n == packed.where("start = 0").selectExpr("sum(doc_tokens) as n").first().n


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_awkward_documents(spark, tiny, stage):
    import corpus_pipeline as P

    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 50_000, None, "s", 9), (3, "a b c", "en", None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        out = P.STAGES[stage][1](spark, docs, tiny)
        assert out.count() >= bool(data)
        if stage < 3:
            assert out.columns == docs.columns
