"""Queries of scalar forms, records, splits and checks, each beside its SQL; values that SQL expects are written out there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import triples as T
from ..operators import graph, joins, metrics, records, selection
from ..sources import ingest
from . import bridge
from .bridge import table
from .oracles import FULL, KG, LOC, PRED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def choice(of: F.Column, *values: str) -> F.Column:
    """One of the values, by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


# Scalars


@query("""SELECT event_id, CASE WHEN event_id % 15 <= 5 THEN TRUE WHEN event_id % 15 <= 11 THEN FALSE END AS flag FROM events""")
def bool_words(spark, d):
    word = choice(F.col("event_id"), "1", "true", "T", " Yes ", "y", "ON", "0", "False", "f", "no", " N", "off", "maybe", "", "2")
    return table(spark, d, "events").select("event_id", S.as_bool(word).alias("flag"))


@query("""SELECT c_custkey, c_custkey % 3 <> 1 AS digest, c_custkey % 3 = 2 AS revision, c_custkey % 4 = 1 AS same FROM customer""")
def digest_forms(spark, d):
    i, sha = F.col("c_custkey"), F.sha2(F.concat_ws("a", F.col("c_custkey").cast("string"), "c_name"), 256)
    digest = F.when(i % 3 == 1, F.concat(sha, F.lit("\n"))).otherwise(sha)
    revision = F.when(i % 3 == 2, F.left(sha, F.lit(40))).when(i % 3 == 1, F.left(sha, F.lit(39))).otherwise(F.concat(F.left(sha, F.lit(39)), F.lit("G")))
    version = F.concat(F.lit("2."), (i % 4).cast("string"), F.lit("+cu12"), (i % 5).cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.is_digest(digest).alias("digest"), S.is_revision(revision).alias("revision"), S.same_version(version, F.lit("2.1")).alias("same"))


@query(f"""WITH {KG} SELECT rec, ctx_pos, t_pos, rec % 3 <> 2 AS known, rec % 3 = 1 AS exact,
CASE WHEN rec % 3 <> 2 THEN '<subj>' || h || '<rel>' || r || '<obj>' || t || '<e>' ELSE '-' END AS form FROM kg""")
def canonical_forms(spark, d):
    x, k = F.struct("h", "r", "t"), F.col("rec") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), T.serialize(x, "private"))).when(k == 1, T.serialize(x)).otherwise(F.concat(T.serialize(x, "public"), F.lit("x")))
    texts = bridge.kg_triples(spark, d).select("rec", F.col("ctx_pos").cast("long").alias("ctx_pos"), F.col("t_pos").cast("long").alias("t_pos"), text.alias("text"))
    return T.with_forms(texts, "text").select("rec", "ctx_pos", "t_pos", "known", "exact", F.coalesce("form", F.lit("-")).alias("form"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '<subj>a<rel>b<obj>c<e>' WHEN 2 THEN '<subj>a<rel>b<obj>c d<e>'
WHEN 3 THEN '<subj>a<rel>b<obj>c<e>|<subj>x<rel>y<obj>z<e>' WHEN 4 THEN '<subj>a<rel>b<obj>c<e>|<subj>a<rel>b<obj>c<e>|<subj>d<rel>b<obj>c<e>' ELSE '-|-' END AS items FROM orders""")
def mixed_collections(spark, d):
    one, two = "<subj>a<rel>b<obj>c<e>", "<subj>d<rel>b<obj>c<e>"
    text = choice(F.col("o_orderkey"), "null", f'"{one}"', '["a", "b", "c  d"]', '[["a", "b", "c"], "<csubj>x<crel>y<cobj>z<ce>"]', f'["{one}", "{one}", "{two}"]', '[["a", "b"], ["a", " ", "c"]]')
    items = T.normalize_collection(F.parse_json(text))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(items, lambda x: F.coalesce(T.serialize(x), F.lit("-"))), "|").alias("items"))


@query("SELECT p_partkey, '/data/' || p_brand || '.d/' || p_partkey AS path, CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.tar' END AS stem FROM part")
def path_stems(spark, d):
    i = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit(".d/"), i)
    return table(spark, d, "part").select("p_partkey", path.alias("path"), S.stem(F.concat(path, F.when(F.col("p_partkey") % 2 == 0, "_done.jsonl").otherwise(".tar.gz")), "_done").alias("stem"))


@query("SELECT doc_id, sha256(text[1:80]) AS digest FROM documents")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(S.excerpt(F.col("text"), 80), 256).alias("digest"))


@query("WITH p AS (SELECT p_partkey, p_brand || '/model-' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.safetensors' WHEN 2 THEN '.bin' ELSE '.jsonl' END AS path FROM part) SELECT p_partkey, path GLOB '*.json' OR path GLOB 'Brand#1?/model-*.[!bj]*' AS allowed FROM p")
def glob_allow_list(spark, d):
    path = F.concat("p_brand", F.lit("/model-"), F.col("p_partkey").cast("string"), choice(F.col("p_partkey"), ".json", ".safetensors", ".bin", ".jsonl"))
    return table(spark, d, "part").select("p_partkey", S.glob_allowed(path, ("*.json", "Brand#1?/model-*.[!bj]*")).alias("allowed"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"run": "out/' || event_id || '", "at": [".", 1, {"x": "b"}]}' WHEN event_id % 3 = 1 THEN '["."]' END AS tree FROM events""")
def redact_json(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit('{"run": "/home/u/out/'), i.cast("string"), F.lit('", "at": ["/home/u", 1, {"x": "/home/u/b"}]}'))).when(i % 3 == 1, '["/home/u"]').otherwise("{")
    return table(spark, d, "events").select("event_id", records.redact_tree(text, "/home/u/").alias("tree"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm=1' WHEN 1 THEN 'm=null' WHEN 2 THEN 'm=null' ELSE 'm=' || event_id END AS found FROM events""")
def json_marker(spark, d):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, 'step RESULT: {"m": 1} ').when(i % 4 == 1, '{"m": 1} without the mark').when(i % 4 == 2, "RESULT: {broken").otherwise(F.concat(F.lit('a {b} RESULT: {"m": '), i.cast("string"), F.lit(', "n": {"o": 1}}')))
    m = F.try_variant_get(ingest.json_after(text, "RESULT: "), "$.m", "long")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("m="), F.coalesce(m.cast("string"), F.lit("null"))).alias("found"))


# Records


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_brand END AS title, CASE WHEN p_partkey % 4 = 2 THEN p_name || chr(10) || 'more' ELSE p_name END AS text FROM part""")
def document_forms(spark, d):
    k, name, brand = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    json = F.to_json(F.struct(F.concat(F.lit(" "), brand).alias("title"), F.concat(name, F.lit(" ")).alias("contents")))
    value = F.when(k == 0, json).when(k == 1, F.concat(F.lit("Title: "), brand, F.lit(" \nCONTENT:  "), name)).when(k == 2, F.concat(brand, F.lit(" \n"), name, F.lit("\nmore "))).otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
    doc = records.parse_document(value)
    return table(spark, d, "part").select("p_partkey", doc["title"].alias("title"), doc["text"].alias("text"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT 'question ' || conv_id AS question, string_agg('chat:' || conv_id || ':' || n || '/' || role, ';' ORDER BY n) AS ctxs, conv_id AS source_index, CAST(2 AS BIGINT) AS top_k FROM c WHERE k >= 2 AND n <= 2 GROUP BY conv_id""")
def retrieved_build(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts")).where(F.size("ts") >= 2)
    rows = turns.select(F.col("conv_id").alias("index"), F.col("conv_id").alias("id"), F.concat(F.lit(" question "), F.col("conv_id").cast("string"), F.lit("\n")).alias("question"), F.array(F.lit("a")).alias("answers"), F.transform("ts", lambda x: F.struct(x["role"].alias("title"), x["text"].alias("text"))).alias("docs"))
    made = records.retrieved_records(rows, "chat", 2)
    return made.select("question", F.array_join(F.transform("ctxs", lambda c: F.concat(c["id"], F.lit("/"), c["title"])), ";").alias("ctxs"), F.col("metadata.source_index").alias("source_index"), F.col("metadata.retrieval_top_k").cast("long").alias("top_k"))


@query("SELECT conv_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' ELSE string_agg(role || '!', ',' ORDER BY turn, role) END AS rewrites FROM conversations GROUP BY conv_id")
def rewrites_attach(spark, d):
    recs = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("ctxs"))
    many = F.transform("ctxs", lambda x: F.concat(x, F.lit("!")))
    made = records.rewritten(recs, records.rewrites_of(F.when(F.size("ctxs") == 1, "one"), many))
    return made.select("conv_id", F.size("anonymized_ctxs").cast("long").alias("n"), F.array_join("anonymized_ctxs", ",").alias("rewrites"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE o_orderpriority END AS question FROM orders WHERE o_orderkey % 3 <> 1")
def question_choice(spark, d):
    k, item = F.col("o_orderkey") % 3, F.struct(F.col("o_orderpriority").alias("question"))
    qa = F.when(k == 0, F.lit(None)).when(k == 1, F.filter(F.array(item), lambda x: F.lit(False))).otherwise(F.array(item, F.struct(F.lit("second").alias("question"))))
    return records.with_question(table(spark, d, "orders").select("o_orderkey", qa.alias("qa"), F.lit("own").alias("question"))).select("o_orderkey", "question")


@query(f"""{LOC}, c AS (SELECT rec, ctx_pos, count(*) FILTER (WHERE p) >= 3 AND count(*) FILTER (WHERE NOT p) >= 1 AS good FROM ll GROUP BY rec, ctx_pos)
SELECT rec, count(*) AS seen, count(*) FILTER (WHERE good) AS kept, count(*) FILTER (WHERE NOT good) AS filtered FROM c GROUP BY rec""")
def flatten_counts(spark, d):
    docs = bridge.local_lists(spark, d)
    tag = lambda c: F.transform(c, lambda v: T.serialize(v))
    recs = docs.groupBy("rec").agg(F.collect_list(F.struct(tag(F.col("public")).alias("public"), tag(F.col("private")).alias("private"))).alias("ctxs"))
    return records.flatten_counts(recs, 3, 1, "rec")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A,b' WHEN 1 THEN 'x,y' WHEN 2 THEN 'plain' WHEN 3 THEN 'Straße' ELSE '' END AS answers FROM events""")
def answers_listed(spark, d):
    text = choice(F.col("event_id"), '["A", "a", " b ", ""]', "['x', 'X ', 'y']", " plain ", '["Straße", "STRASSE"]', "[]")
    return table(spark, d, "events").select("event_id", F.array_join(records.answers_exact(text), ",").alias("answers"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'strasse' WHEN 1 THEN 'σισυφοσ' WHEN 2 THEN 'plain text' ELSE 'ı i̇' END AS key FROM events")
def question_keys(spark, d):
    return table(spark, d, "events").select("event_id", T.question_key(choice(F.col("event_id"), "STRAßE", " ΣΙΣΥΦΟΣ", "Plain \n Text", "ı İ")).alias("key"))


# Splits, alignment and sums


@query(f"""WITH h AS (SELECT doc_id, sha256('42|' || doc_id) AS h FROM documents)
SELECT doc_id, CASE WHEN h < (SELECT max(h) FROM h) AND (h = (SELECT min(h) FROM h) OR h[1:8] < '{int(0.15 * 16**8):08x}') THEN 'validation' ELSE 'train' END AS split FROM h""")
def hash_split(spark, d):
    return selection.hash_split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 0.15)


@query("SELECT event_id // 64 AS batch, count(*) AS n, round(avg((event_id * 11 % 1000) / 1000.0), 9) AS reward, round(avg((event_id * 17 % 1000) / 1000.0), 9) AS seconds FROM events GROUP BY ALL")
def batch_means(spark, d):
    part = lambda k: F.pmod(F.col("event_id") * k, F.lit(1000)) / 1000
    out = metrics.batch_means(table(spark, d, "events").select("event_id", part(11).alias("r"), part(17).alias("s")), "event_id", 64, ("r", "s"))
    return out.select("batch", "n", F.round("mean_r", 9).alias("reward"), F.round("mean_s", 9).alias("seconds"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def keyed_lookup(spark, d):
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.require_all(table(spark, d, "lineitem").select("l_orderkey"), known, ["l_orderkey"], "no order").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, conv_id % 6 AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE k WHEN 1 THEN 'other_id' WHEN 2 THEN 'other_count' WHEN 3 THEN 'bad_text' WHEN 4 THEN 'no_list' WHEN 5 THEN 'no_partner' ELSE 'ok' END AS status FROM c""")
def reuse_check(spark, d):
    k = F.col("conv_id") % 6
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"))).alias("c"))
    as_variant = lambda c: F.parse_json(F.to_json(c))
    source = convs.select("conv_id", F.col("conv_id").cast("string").alias("id"), as_variant("c").alias("ctxs"))
    numbers = F.transform("c", lambda x: F.struct(F.lit(1).alias("text")))
    ctxs = F.when(k == 2, as_variant(F.concat("c", "c"))).when(k == 3, as_variant(numbers)).when(k == 4, F.parse_json(F.lit("{}"))).otherwise(as_variant("c"))
    output = convs.where(k != 5).select("conv_id", F.when(k == 1, "x").otherwise(F.col("conv_id").cast("string")).alias("id"), ctxs.alias("ctxs"))
    return joins.reuse_status(source, output, "conv_id")


@query(f"""{FULL}, {PRED}, p AS (SELECT DISTINCT rec, h, r, t FROM pred), q AS (SELECT DISTINCT rec, h, r, t FROM pri)
SELECT rec, 'extra' AS kind, h, r, t FROM (FROM p EXCEPT FROM q) UNION ALL SELECT rec, 'missing', h, r, t FROM (FROM q EXCEPT FROM p)""")
def mismatch_rows(spark, d):
    triples, private, _ = bridge.graphs(spark, d)
    return joins.mismatch_rows(bridge.rewritten(triples), private, ["h", "r", "t"])


@query(f"{FULL}, e AS (SELECT rec, h AS u, t AS v FROM pri UNION ALL SELECT rec, t, h FROM pri) SELECT rec, u, count(*) AS edges, min(v) AS first FROM e GROUP BY rec, u")
def adjacency(spark, d):
    _, private, _ = bridge.graphs(spark, d)
    return graph.adjacency(graph.edges_of(private, ["rec"]), ["rec"]).groupBy("rec", "u").agg(F.count("*").alias("edges"), F.min("v").alias("first"))
