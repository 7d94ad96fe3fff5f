from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions.triples import TRIPLE
from graphloom.operators import contracts
from graphloom.operators.validate import validate_rl
from graphloom.plans import pipeline
from graphloom.streaming import rows as stream

RECORDS = "rec long, question string, answers array<string>, ctxs array<struct<id:string,title:string,text:string>>"


def test_from_records_to_metrics(spark):
    texts = ["Ada Lovelace worked with Charles Babbage. Charles Babbage lived in London.", "Ada Lovelace wrote to Mary Somerville. Mary Somerville lived in London.", "nothing here"]
    rows = [(i, "Where did Ada Lovelace go?", ["London"], [(f"c{k}", "t", t) for k, t in enumerate(texts)]) for i in range(4)]
    records = spark.createDataFrame(rows, RECORDS)
    done = pipeline.prepare(records, rate=0.5)
    stats = {r.rec: r for r in done.stats.collect()}
    assert len(stats) == 4 and all(r.private_final + r.private_filtered + r.public_final == 4 for r in stats.values())
    out = pipeline.rl_records(records, done)
    checked = validate_rl(out.select(F.col("rec").alias("line"), F.parse_json(F.to_json(F.struct("question", "answers", "public", "privacy", "ctxs"))).alias("v")), True).first()
    assert checked.valid and checked.document_count == 12
    same = pipeline.contexts_of(records).select("rec", "ctx_pos", "text")
    kept, linked = pipeline.score(records, done, same)
    row = kept.first()
    assert row.documents == 12 and row.r_pub == 1.0
    special, open_to = pipeline.evaluation_sets(done)
    assert special.count() >= 0 and open_to.count() >= 0
    assert linked.count() == 1


def test_rows_run_on_streams(spark, tmp_path):
    schema = f"rec long, at timestamp, text string, predicted array<string>, public array<string>, private array<string>, pub array<{TRIPLE}>, pri array<{TRIPLE}>"
    lines = [{"rec": k, "at": f"2024-01-01T00:0{k}:00", "text": "T", "predicted": ["a"], "public": ["a", "b"], "private": [], "pub": [{"h": "a", "r": "b", "t": "c"}], "pri": []} for k in range(8)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(map(json.dumps, lines[4 * k : 4 * k + 4])))
    records = stream.json_stream(spark, str(tmp_path / "in"), schema)
    q = stream.to_parquet(stream.prompts(records.select("rec", "text", F.col("pub").alias("public"), F.col("pri").alias("private"))), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.where("prompt like '%<csubj>a<crel>b<cobj>c<ce>%'").count() == 8
    means = stream.windowed_means(stream.scored(records), "at", late="0 minutes")
    q = stream.to_parquet(means, str(tmp_path / "m"), str(tmp_path / "c2"))
    q.awaitTermination()
    first = spark.read.parquet(str(tmp_path / "m")).first()
    assert (first.n, first.r_pub, first.r_pri) == (5, 0.5, 0.0)


def test_gate_report():
    report = {"schema": "s", "seed": 1, "gate_status": "pass", "metrics": {"sample_count": 2}}
    manifest = {"seed": 1, "data_sha256": "d", "actual_sample_size": 2, "indices": [3, 4]}
    contracts.check_gate_report(report, manifest, "d", 1, "s")
    for r, m in (({"gate_status": "fail"}, {}), ({"schema": "x"}, {}), ({"seed": 2}, {}), ({}, {"indices": [3, 3]}), ({}, {"data_sha256": "e"}), ({"metrics": {"sample_count": True}}, {})):
        with pytest.raises(contracts.ContractError):
            contracts.check_gate_report(report | r, manifest | m, "d", 1, "s")


def test_saved_samples_are_used_again(tmp_path):
    path = str(tmp_path / "m.json")
    first = contracts.sample_indices(path, "d", 100, 5)
    saved = json.loads(Path(path).read_text())
    Path(path).write_text(json.dumps(saved | {"indices": [1, 2, 3, 4, 5]}))
    assert contracts.sample_indices(path, "d", 100, 5) == [1, 2, 3, 4, 5]
    assert contracts.sample_indices(path, "e", 100, 5) == first


def test_configuration():
    good = {"ppo": {"gamma": 0.99}, "reward": {"p_max": 40}, "model": {"revision": "a" * 40}}
    keys = ("ppo.gamma", "reward.p_max", "model.revision")
    contracts.check_configuration(good, keys, ("model.revision",))
    for bad in ({"ppo": {"gamma": 1}}, {"reward": {}}, {"model": {"revision": "main"}}):
        with pytest.raises(contracts.ContractError):
            contracts.check_configuration(good | bad, keys, ("model.revision",))
    with pytest.raises(contracts.ContractError):
        contracts.check_training_arguments(10, 8, 3, 4)


def test_all_but_the_corpus_operators_stands_alone(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "graphloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    n, m = map(int, out.stdout.split())
    assert n >= 70 and m >= 60
