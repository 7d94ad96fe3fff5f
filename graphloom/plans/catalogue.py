"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import triples as T
from ..operators import closure, dedup, evalsets, graph, joins, metrics, models, records, reports, runs, selection, split, validate
from ..operators.lineage import checkpointed, written
from ..sources import ingest
from . import bridge
from .bridge import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STEPS = ("rec", "h", "r", "t")


#: Ordinals, which windows count as ints; results have them as longs, as SQL does.
ORDINALS = ("ctx_pos", "t_pos", "pos", "rank", "place")


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("long") for c in out.columns if c in ORDINALS})

    QUERIES[f.__name__] = run
    return run


def nine(c) -> F.Column:
    return F.round(c, 9)


def num(k: int):
    """A number in [0, 1) from an event's id."""
    return F.pmod(F.col("event_id") * k, F.lit(1000)) / 1000


def x():
    return F.struct("h", "r", "t")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("question"))


# Scalars


@query
def serialize_triples(spark, d):
    return bridge.kg_triples(spark, d).select("rec", "ctx_pos", "t_pos", *(T.serialize(x(), f).alias(f) for f in T.TAGS))


@query
def parse_triples(spark, d):
    kg = bridge.kg_triples(spark, d)
    text = T.serialize(x(), "private")
    broken = F.when(F.col("rec") % 5 == 0, F.concat(F.lit("x"), text)).when(F.col("rec") % 5 == 1, F.concat(text, text)).when(F.col("rec") % 5 == 2, F.replace(text, F.lit("<re>"), F.lit(""))).otherwise(F.replace(text, F.lit("ships "), F.lit("ships \n ")))
    p = kg.select("rec", "ctx_pos", "t_pos", T.parse(broken).alias("p"))
    return p.select("rec", "ctx_pos", "t_pos", *(F.coalesce(f"p.{c}", F.lit("-")).alias(c) for c in "hrt"))


@query
def collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("digest"), F.char_length(T.collapse(F.col("text"))).cast("long").alias("n"))


@query
def fingerprint_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.fingerprint(F.col("lang"), F.col("text")).alias("fp"))
    first = docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return docs.join(first, "fp").select("doc_id", "first_doc", "n")


@query
def penalty_schedule(spark, d):
    return table(spark, d, "events").select("event_id", S.penalty(F.col("event_id")).alias("p"))


@query
def reward(spark, d):
    return table(spark, d, "events").select("event_id", nine(S.reward(num(11), num(13), S.penalty(F.col("event_id")))).alias("reward"))


@query
def prompt_build(spark, d):
    docs = bridge.local_lists(spark, d)
    made = {k: S.prompt(F.concat(F.lit("doc "), F.col("rec").cast("string")), F.col("public"), F.col("private"), k, u) for k, u in (("rewrite", True), ("policy", True), ("test", False))}
    return docs.select("rec", "ctx_pos", *(F.sha2(v, 256).alias(k) for k, v in made.items()))


@query
def pad_ids(spark, d):
    ids = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    out, mask = S.pad_ids(F.col("ids"), 6, -1)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return ids.select("conv_id", text(out).alias("ids"), text(mask).alias("mask"))


@query
def timestamp_text(spark, d):
    return table(spark, d, "events").select("event_id", S.log_time(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123"))).alias("stamp"))


@query
def redact_prefix(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", S.redact_prefix(F.when(F.col("page_id") % 7 == 0, F.lit("http://a/b")).otherwise(F.concat(F.lit("http://a/b/"), F.col("page_id").cast("string"), F.lit(" "), url)), "http://a/b/").alias("text"))


# Order-dependent deduplication


@query
def merge_global(spark, d):
    return dedup.merge_global(bridge.kg_by_record(spark, d)).select("rec", "ctx_pos", "t_pos", "h", "r", "t")


@query
def merge_counters(spark, d):
    return dedup.merge_counters(bridge.kg_by_record(spark, d))


@query
def tail_in_head_filter(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rec"), F.lit(0).alias("ctx_pos"), F.lit(0).alias("t_pos"), F.col("p_name").alias("h"), F.lit("is a").alias("r"), F.substring_index("p_name", " ", -1).alias("t"))
    more = p.select("rec", "ctx_pos", F.lit(1).alias("t_pos"), "h", F.lit("made by").alias("r"), F.lit("Maker").alias("t"))
    return dedup.with_status(p.unionByName(more)).select("rec", "t_pos", "status")


@query
def pair_dedup(spark, d):
    return dedup.first_per_pair(bridge.kg_by_record(spark, d)).select("rec", "ctx_pos", "t_pos", "h", "r", "t")


@query
def pair_counters(spark, d):
    return dedup.pair_counters(bridge.kg_by_record(spark, d))


@query
def edge_dedup(spark, d):
    return dedup.distinct_edges(bridge.kg_by_record(spark, d))


@query
def distinct_triples(spark, d):
    return dedup.distinct_triples(bridge.kg_by_record(spark, d))


@query
def run_groups(spark, d):
    return runs.run_groups(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type").select("run", "event_type", "first", "last", "size", "recurrence")


@query
def run_stats(spark, d):
    return runs.run_stats(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query
def regroup_runs(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    out = runs.regroup(e, "event_id", "event_type", 500, 2)
    return out.select("event_id", "group", "place", records.group_context(F.col("group"), F.col("place")).alias("id"))


@query
def regroup_counts(spark, d):
    return runs.regroup_counts(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 2)


@query
def contiguity(spark, d):
    return runs.contiguity(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "n", "contiguous")


@query
def dup_ctx_ids(spark, d):
    return runs.repeated_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def min_by_key(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return dedup.smallest_per_key(rows, F.col("o_orderpriority"), ("o_totalprice", "o_orderkey")).select("key", "o_totalprice", "o_orderkey")


@query
def first_map_wins(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda v: F.create_map(v["role"], v["turn"])).alias("maps"))
    return records.first_of_each_key(turns, ("conv_id",), "maps").select("conv_id", "key", "value", "pos")


# Selection


@query
def select_unique(spark, d):
    return selection.select_unique(questions(spark, d), "question", "doc_id", 50, strict=False).select("rank", "key", "priority", "index")


@query
def train_eval_split(spark, d):
    ranked = selection.select_unique(questions(spark, d), "question", "doc_id", 60, seed=43, strict=False)
    return selection.train_eval_split(ranked, 40).select("rank", "index", "split")


@query
def exclude_questions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return selection.exclude_keys(docs, "text", table(spark, d, "benchmark"), "text").select("doc_id", "source")


@query
def hash_sample(spark, d):
    return bridge.kg_merged(bridge.kg_by_record(spark, d)).select("rec", "pos", "sampled")


@query
def topk_contexts(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("turn").cast("string")).alias("id"))
    return selection.first_contexts(turns, 2, "conv_id", "turn", "id").select("conv_id", "turn", "id")


@query
def shard_ranges(spark, d):
    return selection.shards(table(spark, d, "documents"), "doc_id", 250)


@query
def seeded_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return selection.seeded_sample(docs, "doc_id", docs.count(), 20).select("doc_id")


@query
def worst_mismatches(spark, d):
    rows = table(spark, d, "orders").select("o_custkey").groupBy("o_custkey").count().select(F.col("o_custkey").alias("index"), F.col("count").alias("missing"))
    return selection.top_n(rows, 20, F.desc("missing"), F.col("index"))


# Joins and sets


@query
def positional_zip(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").unionByName(table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("doc_id")))
    return joins.zip_status(docs, labels, "doc_id")


@query
def localize(spark, d):
    triples, private, _ = bridge.graphs(spark, d)
    return joins.localize(triples, private).select("rec", "ctx_pos", "t_pos", "h", "r", "t")


@query
def localized_lists(spark, d):
    triples, _, public = bridge.graphs(spark, d)
    return joins.localized_lists(triples, public).select("rec", "ctx_pos", F.array_join("items", "").alias("items"))


@query
def edge_anti_join(spark, d):
    triples, private, _ = bridge.graphs(spark, d)
    return joins.edge_difference(triples.select("rec", "h", "t"), private, ["rec", "h", "t"]).groupBy("rec").agg(F.count("*").alias("n"))


@query
def qa_pairs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("rec"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).otherwise("").alias("entity"))
    n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("rec"), F.col("s_name").alias("answer"))
    return joins.qa_pairs(c, n)


@query
def relation_tail_conflict(spark, d):
    _, private, public = bridge.graphs(spark, d)
    return joins.relation_tail_conflicts(public.select(*STEPS), private).distinct()


@query
def log_merge(spark, d):
    a, b = ingest.training_log(bridge.log_lines(spark, d))
    return joins.merge_steps(a, b).select("step", "p", "reward_timestamp", "mean_reward", "mean_r_pub", "mean_r_pri", "learning_rate", "update_timestamp", "update_seconds", "kl")


@query
def log_regex(spark, d):
    v = F.col("value")
    return bridge.log_lines(spark, d).select("line", S.log_count(v, "step").alias("step"), S.log_number(v, "kl").alias("kl"))


@query
def set_sizes(spark, d):
    triples, private, _ = bridge.graphs(spark, d)
    return joins.set_sizes(bridge.rewritten(triples), private, ["h", "r", "t"])


@query
def train_eval_overlap(spark, d):
    t = table(spark, d, "orders")
    return joins.overlap_count(t.where("o_orderstatus = 'F'"), t.where("o_orderstatus = 'O'"), ["o_custkey"])


@query
def local_not_global(spark, d):
    triples, private, public = bridge.graphs(spark, d)
    some = lambda df, p: df.groupBy("rec").agg(F.collect_set(T.serialize(x())).alias(p))
    both = some(triples, "a").join(some(public, "b"), "rec")
    return both.select("rec", joins.not_in_global(F.col("a"), F.col("b")).cast("long").alias("absent"))


# Graphs


@query
def components(spark, d):
    _, private, _ = bridge.graphs(spark, d)
    return graph.components(graph.edges_of(private, ["rec"]), ["rec"])


@query
def reachable_pairs(spark, d):
    _, private, public = bridge.graphs(spark, d)
    labelled = graph.components(graph.edges_of(private, ["rec"]), ["rec"])
    return graph.reachable(public.select("rec", F.col("h").alias("a"), F.col("t").alias("b")), labelled, ["rec"])


@query
def leak_filter(spark, d):
    rows = bridge.marked(spark, d).where("kept").select("rec", "pos", "h", "r", "t", F.col("sampled").alias("hidden"))
    return graph.unleaked(rows).select("rec", "pos", "h", "r", "t")


@query
def promote_round(spark, d):
    _, private, public = bridge.graphs(spark, d)
    return split.promote_round(public, private)


@query
def promote_closure(spark, d):
    merged = bridge.kg_merged(bridge.kg_by_record(spark, d))
    return closure.promotion_closure(merged).select("rec", "pos", "part")


@query
def split_with_qa(spark, d):
    merged = bridge.kg_merged(bridge.kg_by_record(spark, d))
    first = merged.groupBy("rec").agg(F.min_by("h", "pos").alias("entity"), F.max_by("t", "pos").alias("answer"))
    return split.split_graph(merged, first).select("rec", "pos", "part", "flag", "qa_rejected", "private_promoted", "private_filtered")


# Evaluation sets and metrics


@query
def d_special(spark, d):
    docs = bridge.local_lists(spark, d)
    marked = docs.select("rec", evalsets.is_special(F.col("public"), F.col("private")).alias("special"))
    return marked.groupBy("rec").agg(F.count_if("special").alias("special")).where("special >= 2")


@query
def special_contexts(spark, d):
    triples, private, public = bridge.graphs(spark, d)
    return evalsets.special_contexts(joins.localize(triples, public), joins.localize(triples, private))


@query
def inference_attack(spark, d):
    rows = bridge.marked(spark, d).select("rec", "ctx_pos", "h", "r", "t", F.lit(True).alias("local"), F.coalesce(F.col("kept") & F.col("sampled"), F.lit(False)).alias("private"), F.coalesce("kept", F.lit(False)).alias("whole"))
    return evalsets.open_rows(rows).select("rec").distinct()


@query
def retention(spark, d):
    triples, private, public = bridge.graphs(spark, d)
    rows = metrics.retention_rows(bridge.rewritten(triples), joins.localize(triples, public), joins.localize(triples, private), triples, ["rec", "ctx_pos"])
    return rows.select("rec", "ctx_pos", "n_pub", "n_pri", nine("r_pub").alias("r_pub"), nine("r_pri").alias("r_pri"))


def _retention(spark, d):
    triples, private, public = bridge.graphs(spark, d)
    return metrics.retention_rows(bridge.rewritten(triples), joins.localize(triples, public), joins.localize(triples, private), triples, ["rec", "ctx_pos"])


@query
def retention_macro(spark, d):
    return metrics.retention_macro(_retention(spark, d)).withColumns({"r_pub": nine("r_pub"), "r_pri": nine("r_pri")})


@query
def recall_report(spark, d):
    out = metrics.gate(metrics.recall_report(_retention(spark, d)))
    return out.withColumns({c: nine(c) for c in ("public_micro", "private_micro", "public_macro", "private_macro")})


@query
def connectivity(spark, d):
    triples, private, _ = bridge.graphs(spark, d)
    out = metrics.connectivity(metrics.connectivity_rows(private, bridge.rewritten(triples)))
    return out.withColumns({"macro": nine("macro"), "micro": nine("micro")})


@query
def summary_stats(spark, d):
    return metrics.summary(table(spark, d, "documents"), "n_chars", "lang").withColumns({"mean": nine("mean"), "median": nine("median")})


@query
def phase_rollup(spark, d):
    a, _ = ingest.training_log(bridge.log_lines(spark, d))
    out = metrics.phases(a, "p", "step", ("mean_reward", "mean_r_pub"))
    return out.select(F.coalesce("p", F.lit(-1)).alias("p"), "first_step", "last_step", "n", nine("mean_mean_reward").alias("reward"), nine("mean_mean_r_pub").alias("r_pub"))


@query
def tail_multimap(spark, d):
    _, private, _ = bridge.graphs(spark, d)
    return metrics.tail_multimap(private).select("rec", "t", F.size("pairs").cast("long").alias("n"), F.array_join(F.transform("pairs", lambda p: F.concat(p["h"], F.lit("/"), p["r"])), ";").alias("pairs"))


@query
def skip_status(spark, d):
    docs = bridge.local_lists(spark, d).groupBy("rec").agg(F.count("*").alias("n"), F.sum(F.size("private")).alias("k"))
    fill = lambda c: F.array_repeat(F.lit("x"), c.cast("int"))
    status = metrics.skip_status(F.when(F.col("rec") % 7 != 0, fill(F.col("n") - F.when(F.col("rec") % 7 == 1, 1).otherwise(0))), fill(F.col("n")), fill(F.col("k")))
    return docs.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


# Validators


def _variant(rows: DataFrame) -> DataFrame:
    return rows.select("line", F.try_parse_json("value").alias("v"))


@query
def validate_retrieved(spark, d):
    return validate.validate_retrieved(_variant(bridge.retrieved_json(spark, d)), 4)


def _sft(spark, d):
    return reports.describe_sft(_variant(bridge.sft_json(spark, d)))


def _rl(spark, d):
    return reports.describe_rl(_variant(bridge.rl_json(spark, d)), require_qa=True)


def _statistics(described):
    return reports.summary(described).withColumn("mean", nine("mean"))


@query
def validate_sft(spark, d):
    return reports.sft_counts(_sft(spark, d))


@query
def sft_statistics(spark, d):
    return _statistics(_sft(spark, d))


@query
def sft_errors(spark, d):
    return reports.located_errors(_sft(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query
def sft_groups(spark, d):
    # Written first, as ranges are drawn from a sample, for which the rows would be made once more.
    return runs.run_stats(written(_sft(spark, d).where("fp is not null").select("line", "fp")), "line", "fp")


@query
def validate_rl(spark, d):
    described = checkpointed(_rl(spark, d))
    mean = reports.summary(described).where("measure = 'local_public_triples_per_document'").select(nine("mean").alias("mean_local_public"))
    out = reports.rl_counts(described).crossJoin(F.broadcast(mean))
    return out.withColumns({c: nine(c) for c in out.columns if c.endswith("_ratio")})


@query
def rl_statistics(spark, d):
    return _statistics(_rl(spark, d))


@query
def rl_errors(spark, d):
    return reports.located_errors(_rl(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query
def metric_bounds(spark, d):
    e = table(spark, d, "events")
    found = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.col("value") / 20).alias("rate"))
    want = e.groupBy("event_type").agg((F.count("*") + F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("n"))
    return validate.check_metrics(found, want, "event_type", ("n",), ("rate",)).select("event_type", "want_n", "valid")


@query
def json_typed_scan(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")).alias("kind"), F.try_variant_get(v, "$.k", "long").alias("k"), validate.is_text(v, "$.k").alias("is_text"))


@query
def record_counts(spark, d):
    docs = table(spark, d, "documents")
    return validate.conserved({"a": docs, "b": docs.where("doc_id >= 0"), "c": docs.where("doc_id > 0")})


# Records and models


@query
def count_filter(spark, d):
    docs = bridge.local_lists(spark, d)
    return docs.where((F.size(F.array_distinct("public")) >= 5) & (F.size(F.array_distinct("private")) >= 2)).select("rec", "ctx_pos")


@query
def flatten_examples(spark, d):
    docs = bridge.local_lists(spark, d)
    tag = lambda c: F.transform(c, lambda v: T.serialize(v))
    recs = docs.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("ctx_pos", F.struct(F.col("ctx_pos").cast("string").alias("text"), tag(F.col("public")).alias("public"), tag(F.col("private")).alias("private")).alias("c")))), lambda v: v["c"]).alias("ctxs"))
    return records.flatten_examples(recs, least_public=3, least_private=1).select("rec", "text", F.size("public").cast("long").alias("n_public"), F.size("private").cast("long").alias("n_private"))


@query
def hotpot_zip(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))
    docs = records.zipped_documents(F.transform("ts", lambda v: v["role"]), F.transform("ts", lambda v: F.split(v["text"], "\n")))
    made = turns.select("conv_id", F.posexplode(records.ranked_contexts(docs, "chat", F.col("conv_id"), 3)).alias("pos", "c"))
    return made.select("conv_id", "pos", F.col("c.id").alias("id"), F.col("c.title").alias("title"), F.sha2("c.text", 256).alias("digest"))


@query
def answers_distinct(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda v: F.when(v["event_id"] % 2 == 0, F.upper(v["event_type"])).otherwise(F.concat(F.lit(" "), v["event_type"]))).alias("a"))
    return rows.select("user_id", F.array_join(records.answers_lower(F.col("a")), ",").alias("answers"))


@query
def coref_identity(spark, d):
    return models.resolve(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", F.sha2("text", 256).alias("digest"), "timed_out")


@query
def extract_rules(spark, d):
    return models.extract(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])


@query
def question_entities(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.explode_outer(models.entities(F.col("text"))).alias("entity"))
    return rows.groupBy("item_id").agg(F.count("entity").alias("n"))


@query
def template_rewrite(spark, d):
    docs = bridge.local_lists(spark, d)
    text = F.array_join(F.transform("private", lambda v: F.concat_ws(" ", v["h"], v["r"], v["t"])), ". ")
    return docs.select("rec", "ctx_pos", F.sha2(models.redact(text, F.col("private")), 256).alias("digest"))
