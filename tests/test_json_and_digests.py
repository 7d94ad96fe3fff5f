from __future__ import annotations

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import ingest


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few hundred bytes, so that arrays go over many tasks."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("300", "1", "64"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def value(rng, depth=0):
    texts = ["", "plain", 'quote " and \\ back', "}{][", "a } , { b", "é\n\t", '\\"', "\\\\", "]", "\U0001f600"]
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(texts)
    if kind < 4:
        return rng.choice([None, True, -1, 2.5, 10**6])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "}", '"', "{["]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(spark, path):
    rows = ingest.json_elements(spark, path).select("file", "element", F.to_json("v").alias("j")).orderBy("file", "element").collect()
    return [(r.file.rsplit("/", 1)[1], r.element, json.loads(r.j)) for r in rows]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_over_blocks_equal_the_library(spark, small_blocks, tmp_path, indent):
    rng = random.Random(7)
    want = []
    for k in range(3):
        data = [{"i": i, "v": value(rng)} if k < 2 or rng.random() < 0.6 else value(rng) for i in range(60)]
        (tmp_path / f"{k}.json").write_text(json.dumps(data, indent=indent, ensure_ascii=bool(k)) + "\n" * k)
        want += [(f"{k}.json", i, x) for i, x in enumerate(data)]
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert elements(spark, str(tmp_path)) == want
    first = ingest.json_array(spark, str(tmp_path / "0.json"), limit=7).collect()
    assert sorted(r.rec for r in first) == list(range(7))


SMALL = [("[]", []), (" [ ] \n", []), ("\n", []), ('{"a": [1, {"b": "}"}]}\n', [{"a": [1, {"b": "}"}]}]), ("{}", [{}]), ("\ufeff[1, 2]", [1, 2]), ('\ufeff{"a": 1}', [{"a": 1}]), ('[[{"a":1}],{"b":2}, 3 ]', [[{"a": 1}], {"b": 2}, 3]), ('["}", {"a": "{"}]', ["}", {"a": "{"}])]


def test_small_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    for k, (text, _) in enumerate(SMALL):
        (tmp_path / f"{k}.json").write_text(text)
    assert elements(spark, str(tmp_path)) == [(f"{k}.json", i, x) for k, (_, want) in enumerate(SMALL) for i, x in enumerate(want)]


@pytest.mark.parametrize("text", ["3", '[{"a": 1}', '{"a": 1', '[{"a": 1},]', '[{"a": 1}{"a": 2}]', '{"a": 1}{"a": 2}', '[{"a": 1}] x', '[{"a" 1}]'])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="(?i)json|bracket|comma"):
        elements(spark, str(tmp_path / "x.json"))


def test_packed_arrays(spark, tmp_path):
    for name, data in (("a", [{"x": i} for i in range(50)]), ("b", {"x": {"y": {}}})):
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(data).encode()))
    assert [x for _, _, x in elements(spark, str(tmp_path))] == [{"x": i} for i in range(50)] + [{"x": {"y": {}}}]


LOG = 'noise } { "\nSTART: \n  {"a": "}", "b": {"c": "\\"}"},\n "d": [1, 2]}  tail } START: {"a": 2}\nmore { \n'


def test_object_after_a_marker(spark, small_blocks, tmp_path):
    (tmp_path / "a.log").write_text(LOG * 3)
    (tmp_path / "b.log").write_text("no mark {}")
    (tmp_path / "c.log").write_text("START: never")
    (tmp_path / "d.log").write_text("START: {unclosed")
    got = {r.file.rsplit("/", 1)[1]: r.j for r in ingest.json_after_marker(spark, str(tmp_path), "START: ").select("file", F.to_json("v").alias("j")).collect()}
    want = {"a": "}", "b": {"c": '"}'}, "d": [1, 2]}
    assert json.loads(got["a.log"]) == want and got["c.log"] is None and got["d.log"] is None and set(got) == {"a.log", "c.log", "d.log"}
    texts = {LOG: want, "no mark {}": None, "START: ": None, "START: {": None, 'x START: START: {"a": "{"}}': {"a": "{"}, "START: {not json}": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select("t", F.to_json(ingest.json_after(F.col("t"), "START: ")).alias("j")).collect()
    assert {r.t: r.j and json.loads(r.j) for r in rows} == {**texts, None: None}


CONTENTS = {"lf": b'{"a": 1}\n\n{"a": 2}\n', "open": b"a\n b", "crlf": b"a\r\nb\r\n", "bytes": bytes(range(256)) * 50, "zero": b"x\n\0", "empty": b"", "feed": b"\n", "wide": b"w" * 300_000 + b"\nend", "with space": b"s\n"}
MARKED = {"mark": b"\xef\xbb\xbfa\n", "mark open": b"\xef\xbb\xbfa\nb"}


def test_digests_are_streams_of_lines(spark, small_blocks, tmp_path):
    for name, data in CONTENTS.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    for name, data in MARKED.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    name_of = lambda p: p.rsplit("/", 1)[1].rsplit(".", 1)[0].replace("%20", " ")
    digest = {k: hashlib.sha256(v).hexdigest() for k, v in CONTENTS.items()}
    plain = ingest.file_digests(spark, str(tmp_path / "*.txt")).collect()
    assert {name_of(r.path): (r.length, r.sha256) for r in plain} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in (CONTENTS | MARKED).items() if v}
    packed = ingest.inspect_gzip(spark, str(tmp_path / "*.gz")).collect()
    assert {name_of(r.path): (r.sha256, r.lines) for r in packed} == {k: (digest[k], sum(bool(x.strip()) for x in v.split(b"\n"))) for k, v in CONTENTS.items()}
    assert all(r.compressed_bytes > 0 for r in packed)


def test_a_packed_file_far_larger_than_a_batch(spark, tmp_path):
    """200 MB of lines from 200 KB: a task holds a line and a digest's state."""
    block = b"x" * 99 + b"\n"
    want = hashlib.sha256()
    with gzip.open(tmp_path / "big.gz", "wb", compresslevel=1) as f:
        for _ in range(200):
            f.write(block * 10_000)
            want.update(block * 10_000)
    row = ingest.inspect_gzip(spark, str(tmp_path / "big.gz")).first()
    assert (row.sha256, row.lines) == (want.hexdigest(), 2_000_000)
