from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import models, records, reports, validate
from graphloom.sources import ingest, sinks


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": "é"}\n  \n{"a": null}\n', encoding="utf-8")
    return str(p)


def test_json_lines(spark, lines, tmp_path):
    rows = ingest.json_lines(spark, lines).select("line", "rec", F.to_json("v").alias("j")).orderBy("rec").collect()
    assert [(r.line, r.rec, json.loads(r.j)) for r in rows] == [(1, 0, {"a": 1}), (3, 1, {"a": "é"}), (5, 2, {"a": None})]
    assert [r.rec for r in ingest.json_lines(spark, lines, start=1, limit=1).collect()] == [1]
    with pytest.raises(Exception, match="blank line 2"):
        ingest.json_lines(spark, lines, blanks="error").collect()
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[]\n{\n')
    with pytest.raises(Exception, match="no JSON object in line"):
        ingest.json_lines(spark, str(bad)).collect()
    assert [r.v is None for r in ingest.json_lines(spark, str(bad), bad="null").orderBy("line").collect()] == [False, False, True]
    assert (ingest.count_lines(spark, lines), ingest.count_lines(spark, lines, blanks=True)) == (3, 5)


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    texts = {"b.jsonl": 300, "a.jsonl": 50, "c.jsonl": 0}
    for name, n in texts.items():
        (tmp_path / "d" / name).write_text("".join(f'{{"f": "{name[0]}", "k": {k}}}\n' + ("\n" if k % 7 == 0 else "") for k in range(n)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = ingest.json_lines(spark, str(tmp_path / "d")).selectExpr("rec", "line", "v:f::string f", "v:k::long k").orderBy("rec").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.f, r.k) for r in got] == [("a", k) for k in range(50)] + [("b", k) for k in range(300)]
    assert [r.rec for r in got] == list(range(350)) and got[1].line == 3


def test_parquet_in_path_order(spark, tmp_path):
    for name, ids in (("b", [3, 4]), ("a", [1, 2])):
        spark.createDataFrame([(i, "x") for i in ids], "i long, z string").coalesce(1).write.parquet(str(tmp_path / name))
    got = ingest.parquet_in_order(spark, [str(tmp_path / n) for n in "ba"], ["i"]).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_fetch_and_arrays(spark, tmp_path):
    df = ingest.numbered(spark.createDataFrame([("a",), ("b",), ("c",)], "v string").coalesce(1))
    assert [r.v for r in ingest.fetch(df, "rec", [2, 0]).orderBy("rec").collect()] == ["a", "c"]
    with pytest.raises(Exception, match="no row 9"):
        ingest.fetch(df, "rec", [9]).collect()
    p = tmp_path / "x.json"
    p.write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in ingest.json_array(spark, str(p), "a long").collect()] == [1, 2]


def test_gzip_and_artifacts(spark, tmp_path):
    data = b'{"a": 1}\n\n{"a": 2}\n'
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(data))
    found = ingest.inspect_gzip(spark, str(tmp_path / "x.jsonl.gz"))
    row = found.first()
    assert (row.sha256, row.lines) == (hashlib.sha256(data).hexdigest(), 2)
    manifest = spark.createDataFrame([("x.jsonl.gz", 2, row.compressed_bytes, row.sha256), ("y.gz", 1, 1, "0")], "file string, records long, compressed_bytes long, sha256 string")
    assert {r.file: r.valid for r in sinks.verify_artifacts(found, manifest).collect()} == {"x.jsonl.gz": True, "y.gz": False}


def test_training_log(spark):
    text = ["2024-01-02 03:04:05,678 INFO step=1 p=20 mean_reward=0.1 mean_r_pub=.2 mean_r_pri=1e-2 lr=1e-5", "2024-01-02 03:04:06,000 INFO step=1 update_seconds=8.5 kl=-0.25", "noise", "2024-01-02 03:04:06,000 Saved final checkpoint: /a", "2024-01-02 03:04:06,000 Saved final checkpoint: /b"]
    df = spark.createDataFrame(list(enumerate(text)), "line long, value string")
    a, b = ingest.training_log(df)
    assert tuple(a.first()) == (1, 20, "2024-01-02T03:04:05.678+08:00", 0.1, 0.2, 0.01, 1e-5)
    assert tuple(b.first()) == (1, "2024-01-02T03:04:06.000+08:00", 8.5, -0.25)
    assert ingest.last_checkpoint(df, "line").first().path == "/b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_lines(df, str(tmp_path / "j"))
    with pytest.raises(ValueError, match="same path"):
        sinks.guard("/a/", "/a")
    assert json.loads(sinks.pretty(df.agg(F.count("*").alias("n")))) == {"n": 2}
    assert "| n | 2 |" in sinks.markdown(df.agg(F.count("*").alias("n")), "T")


def test_answers(spark):
    df = spark.createDataFrame([(["Paris", " paris ", "", None, "City of Paris"],)], "a array<string>")
    assert df.select(records.answers_lower(F.col("a")).alias("x")).first().x == ["Paris", "City of Paris"]
    texts = spark.createDataFrame([('["Straße", "STRASSE", "x"]',), ("['a', 'A']",), ("plain",), (" ",)], "t string")
    assert [r.x for r in texts.select(records.answers_exact("t").alias("x")).collect()] == [["Straße", "x"], ["a"], ["plain"], []]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"title": " T ", "contents": "body"}', ("T", "body")),
        ("Title: A b\nContent: some\ntext", ("A b", "some\ntext")),
        ("First line\nrest\nmore", ("First line", "rest\nmore")),
        (" only body ", ("", "only body")),
    ],
)
def test_documents_in_many_forms(spark, text, expected):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(records.parse_document(F.col("t")).alias("d")).first().d) == expected


def test_documents_in_python_notation(spark):
    df = spark.createDataFrame([("{'page_title': 'T', 'text': 'it\\'s'}",), ("{broken",), (None,)], "t string").select(records.as_json("t").alias("t"))
    got = [r.d for r in df.select(records.parse_document(F.col("t")).alias("d")).collect()]
    assert tuple(got[0]) == ("T", "it's") and tuple(got[1]) == ("", "{broken") and got[2].text is None


def test_trees_are_redacted_at_any_depth(spark):
    value = {"a": ["/x/y/z", {"b": "/x/y"}, 3, None], "/x/y/k": "no /x/y/q"}
    df = spark.createDataFrame([(json.dumps(value),), ("{",), (None,)], "t string")
    got = [r.x for r in df.select(records.redact_tree(F.col("t"), "/x/y/").alias("x")).collect()]
    assert json.loads(got[0]) == {"a": ["z", {"b": "."}, 3, None], "/x/y/k": "no q"} and got[1:] == [None, None]


def test_retrieved_records(spark):
    docs = [("T1", "a"), ("T2", "b"), ("T3", "c")]
    ddl = "index long, id string, question string, answers array<string>, docs array<struct<title:string,text:string>>"
    row = records.retrieved_records(spark.createDataFrame([(4, "s", " Q? ", ["x"], docs)], ddl), "set", 2).first()
    assert (row.question, [tuple(c) for c in row.ctxs], row.metadata.source_index) == ("Q?", [("set:s:1", "T1", "a"), ("set:s:2", "T2", "b")], 4)
    with pytest.raises(Exception, match="fewer than 4"):
        records.retrieved_records(spark.createDataFrame([(4, "s", "Q", ["x"], docs)], ddl), "set", 4).collect()


def test_first_map_wins_and_long_form(spark):
    ddl = "rec long, ctxs array<struct<id:long>>, triplets array<map<string,array<array<string>>>>"
    df = spark.createDataFrame([(1, [(7,), (8,)], [{"7": [["a", "r", "b"]]}, {"7": [["x", "r", "y"]], "8": [["c", "r", "d"]]}])], ddl)
    got = [tuple(r) for r in records.long_triples(df).orderBy("ctx_pos").collect()]
    assert got == [(1, "7", 0, 0, "a", "r", "b"), (1, "8", 1, 0, "c", "r", "d")]


def variant(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(rows, 1)], "line long, j string").select("line", F.try_parse_json("j").alias("v"))


def test_retrieved_validator_counts_errors(spark):
    ctx = [{"id": "a", "title": "t", "text": "x"}, {"id": "b", "title": "t", "text": "x"}]
    good = {"question": "Q", "answers": ["a"], "ctxs": ctx}
    rows = variant(spark, good, good | {"ctxs": ctx[:1]}, good | {"ctxs": [ctx[0], ctx[0]]}, good | {"question": 1, "answers": []}, "{", [])
    out = validate.validate_retrieved(rows, 2).first()
    assert (out.records, out.contexts, out.invalid_records, out.valid) == (6, 6, 6, False)
    assert validate.validate_retrieved(variant(spark, good), 2).first().valid


def test_rl_and_sft_validators(spark):
    tag = "<subj>a<rel>b<obj>c<e>"
    good = {"question": "Q", "answers": ["a"], "public": [["a", "b", "c"]], "privacy": [], "ctxs": [{"id": 1, "text": "x", "public": [tag], "private": []}]}
    bad = [good | {"privacy": [["a", "b", "c"]]}, good | {"ctxs": []}, good | {"ctxs": [{"id": 1, "text": "x", "public": ["<subj>z<rel>b<obj>c<e>"], "private": []}]}, good | {"public": [["a", "b"]]}, {"public": []}]
    assert reports.rl_counts(reports.describe_rl(variant(spark, good), True)).first().valid
    assert reports.rl_counts(reports.describe_rl(variant(spark, good, *bad))).first().records_with_errors == 5
    row = {"public": [["a", "b", "c"]], "private": [], "text": "x", "anonymized_text": "y", "o_public": [tag], "o_private": []}
    assert reports.sft_counts(reports.describe_sft(variant(spark, row))).first().valid
    out = reports.report(reports.describe_sft(variant(spark, row, row | {"text": " "}, row | {"o_private": [tag]}, row | {"o_public": ["<csubj>a<crel>b<cobj>c<ce>"]})), "sft")
    assert (out["counts"]["records_total"], out["counts"]["records_with_errors"], out["groups"]["segments"]) == (4, 3, 1)


def test_models(spark):
    df = spark.createDataFrame([(1, "Ada Lovelace worked with Charles Babbage."), (2, ""), (3, None)], "i long, text string")
    assert [tuple(r) for r in models.extract(df, "text", ["i"]).collect()] == [(1, 0, "Ada Lovelace", "worked with", "Charles Babbage")]
    with pytest.raises(Exception, match="another number of results"):
        models.extract(df, "text", ["i"], lambda: lambda texts: []).collect()
    slow = models.resolve(df, "text", lambda: lambda texts: ["changed"] * len(texts), seconds=-1.0).orderBy("i").collect()
    assert slow[0].text.startswith("Ada") and slow[0].timed_out


def test_first_qa_item_asks_and_empty_lists_go(spark):
    rows = [(1, [("q1", "a"), ("q2", "b")], "own"), (2, [], "own"), (3, None, "own"), (4, [(None, "a")], "own")]
    df = spark.createDataFrame(rows, "rec long, qa array<struct<question:string,answer:string>>, question string")
    assert {r.rec: r.question for r in records.with_question(df).collect()} == {1: "q1", 3: "own", 4: "own"}


def test_words_for_true_and_false(spark):
    from graphloom.functions import scalars

    words = {"1": True, "true": True, "T": True, " t ": True, "yes": True, "y": True, "on": True, "0": False, "False": False, "f": False, "no": False, "N": False, "off": False, "": None, "maybe": None, "tt": None}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    assert {r.w: r.b for r in df.select("w", scalars.as_bool(df.w).alias("b")).collect()} == words | {None: None}
