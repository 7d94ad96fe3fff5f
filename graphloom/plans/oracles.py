"""For each query that SQL can express, DuckDB SQL over the same tables."""

from __future__ import annotations

import random

from ..functions.triples import SPACE_RANGES
from ..functions.scalars import ANSWER_MARK, TASK_REWRITE, TASK_TRAIN

KG = """kg AS (SELECT o_custkey AS rec, CAST(o_orderkey AS VARCHAR) AS ctx_id, ctx_pos,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS t_pos,
  'Supplier ' || l_suppkey AS h, 'ships ' || split_part(p_name, ' ', 1) AS r, p_brand AS t
  FROM lineitem JOIN (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ctx_pos FROM orders) ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
DEDUP = """st AS (SELECT *, CASE WHEN contains(h, t) THEN 'substring'
    WHEN row_number() OVER w = 1 THEN 'kept' WHEN first_value(t) OVER w = t THEN 'duplicate' ELSE 'collision' END AS status
  FROM kg WINDOW w AS (PARTITION BY rec, h, r, contains(h, t) ORDER BY ctx_pos, t_pos)),
merged AS (SELECT * EXCLUDE (status), row_number() OVER (PARTITION BY rec ORDER BY ctx_pos, t_pos) - 1 AS pos FROM st WHERE status = 'kept'),
drawn AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY sha256('42|' || rec || '|' || pos), pos) <= floor(count(*) OVER (PARTITION BY rec) * 0.25) AS sampled FROM merged),
pri AS (SELECT * FROM drawn WHERE sampled), pub AS (SELECT * FROM drawn WHERE NOT sampled)"""
LOCAL = """lp AS (SELECT rec, ctx_pos, h, r, t, min(t_pos) AS t_pos, TRUE AS p FROM kg WHERE (rec, h, r, t) IN (SELECT rec, h, r, t FROM pub) GROUP BY ALL),
ls AS (SELECT rec, ctx_pos, h, r, t, min(t_pos) AS t_pos, FALSE AS p FROM kg WHERE (rec, h, r, t) IN (SELECT rec, h, r, t FROM pri) GROUP BY ALL),
ll AS (FROM lp UNION ALL FROM ls)"""
PRED = "pred AS (SELECT * FROM kg WHERE md5(rec || '|' || h || '|' || r || '|' || t)[1:1] >= '4')"
SPACE = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SPACE_RANGES) + "]"
COLLAPSED = f"regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def neutral(a: str = "", tags: tuple[str, str, str, str] = ("<subj>", "<rel>", "<obj>", "<e>")) -> str:
    return f"'{tags[0]}' || {a}h || '{tags[1]}' || {a}r || '{tags[2]}' || {a}t || '{tags[3]}'"


PUBLIC, PRIVATE = ("<csubj>", "<crel>", "<cobj>", "<ce>"), ("<rsubj>", "<rrel>", "<robj>", "<re>")


def reach(name: str, edges: str, keys: str) -> str:
    """A recursive view (keys, src, node) of what is reached from every node of ``edges`` (keys, u, v)."""
    same = " AND ".join(f"e.{k} = x.{k}" for k in keys.split(", "))
    return f"""{name}_e AS (SELECT {keys}, u, v FROM ({edges}) UNION SELECT {keys}, v, u FROM ({edges})),
{name} AS (SELECT {keys}, u AS src, u AS node FROM {name}_e UNION SELECT {", ".join("x." + k for k in keys.split(", "))}, x.src, e.v FROM {name} x JOIN {name}_e e ON {same} AND e.u = x.node)"""


#: Rounds of the promotion closure that SQL writes out; the tables need fewer.
ROUNDS = 12
ALIKE = "(contains({0}, {1}) OR contains({1}, {0}))"


def connected(pairs: str, name: str, keys: str) -> str:
    """Distinct (keys, a, b) of pairs where b or a name alike is reached from a."""
    same = " AND ".join(f"g.{k} = q.{k}" for k in keys.split(", "))
    return f"""SELECT DISTINCT {keys}, a, b FROM ({pairs}) q WHERE {ALIKE.format("a", "b")}
      OR EXISTS (SELECT 1 FROM {name} g WHERE {same} AND g.src = q.a AND {ALIKE.format("g.node", "q.b")})"""


def closure(rounds: int) -> str:
    """The promotion closure, its rule stated anew for every round; a round after the fixed point changes nothing."""
    steps = ["s0 AS (SELECT rec, pos, h, r, t FROM pri)"]
    for k in range(rounds):
        steps.append(reach(f"g{k}", f"SELECT rec, h AS u, t AS v FROM s{k}", "rec"))
        steps.append(f"o{k} AS (SELECT rec, pos, h, r, t FROM merged ANTI JOIN s{k} USING (rec, pos))")
        steps.append(f"c{k} AS ({connected(f'SELECT rec, h AS a, t AS b FROM o{k}', f'g{k}', 'rec')})")
        steps.append(f"""s{k + 1} AS MATERIALIZED (FROM s{k} UNION SELECT o.* FROM o{k} o SEMI JOIN c{k} c ON c.rec = o.rec AND c.a = o.h AND c.b = o.t
  UNION SELECT o.* FROM o{k} o SEMI JOIN s{k} p ON p.rec = o.rec AND p.r = o.r AND p.t = o.t AND {ALIKE.format("p.h", "o.h")})""")
    last = f"s{rounds}"
    shown = f"SELECT rec, h, t FROM merged ANTI JOIN {last} USING (rec, pos)"
    steps.append(reach("gz", f"SELECT rec, h AS u, t AS v FROM ({shown})", "rec"))
    steps.append(f"cz AS ({connected(f'SELECT rec, h AS a, t AS b FROM {last}', 'gz', 'rec')})")
    return f"""{FULL}, {", ".join(steps)}
SELECT m.rec, m.pos, CASE WHEN s.pos IS NULL THEN 'public' WHEN cz.a IS NOT NULL THEN 'leaked' ELSE 'private' END AS part
FROM merged m LEFT JOIN {last} s ON s.rec = m.rec AND s.pos = m.pos LEFT JOIN cz ON s.rec = cz.rec AND cz.a = m.h AND cz.b = m.t"""


def n1000(k: int) -> str:
    return f"(event_id * {k} % 1000) / 1000.0"


LOGP = "least(20 + CAST(floor(event_id / 350) AS BIGINT) * 5, 40)"
STAMP = "replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '+08:00'"
RUNS = "WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, CAST(sum(s) OVER (ORDER BY event_id) - 1 AS BIGINT) AS g FROM a)"
REF = f"""WITH RECURSIVE {KG}, {DEDUP}, {LOCAL}, {PRED},
pd AS (SELECT DISTINCT rec, ctx_pos, h, r, t FROM pred),
rr AS (SELECT d.rec, d.ctx_pos, count(*) FILTER (WHERE l.p) AS n_pub, count(*) FILTER (WHERE NOT l.p) AS n_pri,
  count(*) FILTER (WHERE l.p AND pd.h IS NOT NULL) AS k_pub, count(*) FILTER (WHERE NOT l.p AND pd.h IS NOT NULL) AS k_pri
  FROM (SELECT DISTINCT rec, ctx_pos FROM kg) d LEFT JOIN ll l ON l.rec = d.rec AND l.ctx_pos = d.ctx_pos
  LEFT JOIN pd ON pd.rec = l.rec AND pd.ctx_pos = l.ctx_pos AND pd.h = l.h AND pd.r = l.r AND pd.t = l.t GROUP BY ALL),
r AS (SELECT *, CASE WHEN n_pub = 0 THEN 1.0 ELSE k_pub / n_pub END AS r_pub, CASE WHEN n_pri = 0 THEN 0.0 ELSE k_pri / n_pri END AS r_pri FROM rr)"""


def prompts(kind: str, prefix: bool) -> str:
    task = TASK_REWRITE if kind != "policy" else TASK_TRAIN
    label = "private triples: " if kind == "policy" else "privacy triples: "
    gap = "" if kind == "test" else "chr(10) || chr(10) || "
    marks = [f"{gap}'{m}' || " if prefix else "" for m in ("text: ", label, "public triples: ")]
    tail = "" if kind == "test" else f" || '{ANSWER_MARK}'"
    return f"sha256('{task}' || {marks[0]}'doc ' || rec || {marks[1]}pri_s || {marks[2]}pub_s{tail}) AS {kind}"


BASE = f"WITH {KG}"
FULL = f"WITH RECURSIVE {KG}, {DEDUP}"
LOC = f"WITH RECURSIVE {KG}, {DEDUP}, {LOCAL}"
QUESTION = r"replace(lower(trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20]+', ' ', 'g'))), 'ß', 'ss')"


def unique(seed: int, n: int) -> str:
    return f"""WITH k AS (SELECT {QUESTION} AS key, doc_id, sha256('{seed}' || chr(0) || {QUESTION} || chr(0) || doc_id) AS priority FROM documents),
b AS (SELECT key, min(struct_pack(p := priority, i := doc_id)) AS s FROM k WHERE key <> '' GROUP BY key),
x AS (SELECT key, s.p AS priority, s.i AS "index", row_number() OVER (ORDER BY s.p, s.i, key) AS rank FROM b)"""


SFT_ROWS = f"""{LOC}, d AS (SELECT rec * 100 + ctx_pos AS line, (rec * 100 + ctx_pos) % 50 AS m, (rec * 100 + ctx_pos) % 50 NOT IN (3, 5) AS whole, count(*) FILTER (WHERE p) AS a, count(*) FILTER (WHERE NOT p) AS b,
  string_agg(CAST(p AS VARCHAR) || '|' || h || '|' || r || '|' || t, ';' ORDER BY p, t_pos) AS x FROM ll GROUP BY rec, ctx_pos)"""
RL_ROWS = f"{LOC}, d AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ctx_pos) - 1 AS k FROM (SELECT rec, rec % 40 AS m, ctx_pos, count(*) FILTER (WHERE p) AS a, count(*) FILTER (WHERE NOT p) AS b FROM ll GROUP BY ALL))"
RL_ERRORS = """SELECT rec, 100 + k AS o, 'ctxs[' || k || '].id' AS location, 'duplicate context ID within query' AS message FROM d x WHERE m = 1 AND ctx_pos = 1 AND EXISTS (SELECT 1 FROM d y WHERE y.rec = x.rec AND y.ctx_pos = 0)
  UNION ALL SELECT rec, 100 + k, 'ctxs[' || k || '].text', 'must be a non-empty string' FROM d WHERE m = 2 AND ctx_pos = 0
  UNION ALL SELECT DISTINCT rec, 0, 'privacy[0]', 'triple items must not be empty or hold tags' FROM d WHERE m = 3
  UNION ALL SELECT rec, 100 + k, 'ctxs[' || k || '].private', b || ' local triples are absent from global privacy' FROM d WHERE m = 3 AND b > 0
  UNION ALL SELECT DISTINCT rec, 0, 'ctxs', 'missing required field' FROM d WHERE m = 4"""
STATISTICS = "SELECT s.m AS measure, count(*) AS count, CAST(min(s.v) AS BIGINT) AS min, CAST(max(s.v) AS BIGINT) AS max, round(avg(s.v), 9) AS mean, median(s.v) AS median FROM v GROUP BY s.m"

ORACLES: dict[str, str] = {
    "serialize_triples": f"{BASE} SELECT rec, ctx_pos, t_pos, {neutral()} AS neutral, {neutral(tags=PUBLIC)} AS public, {neutral(tags=PRIVATE)} AS private FROM kg",
    "parse_triples": f"{BASE} SELECT rec, ctx_pos, t_pos, " + ", ".join(f"CASE WHEN rec % 5 >= 3 THEN {c} ELSE '-' END AS {c}" for c in "hrt") + " FROM kg",
    "collapse_ws": f"SELECT doc_id, sha256({COLLAPSED}) AS digest, length({COLLAPSED}) AS n FROM documents",
    "fingerprint_docs": "SELECT doc_id, min(doc_id) OVER w AS first_doc, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY lang, text)",
    "penalty_schedule": f"SELECT event_id, CAST({LOGP} AS BIGINT) AS p FROM events",
    "reward": f"SELECT event_id, round(CAST({n1000(11)} AS DOUBLE) * exp(-{LOGP} * CAST({n1000(13)} AS DOUBLE)), 9) AS reward FROM events",
    "prompt_build": f"{LOC}, s AS (SELECT rec, ctx_pos, coalesce(string_agg({neutral(tags=PUBLIC)}, '' ORDER BY t_pos) FILTER (WHERE p), '') AS pub_s, coalesce(string_agg({neutral(tags=PRIVATE)}, '' ORDER BY t_pos) FILTER (WHERE NOT p), '') AS pri_s FROM ll GROUP BY ALL) SELECT rec, ctx_pos, {prompts('rewrite', True)}, {prompts('policy', True)}, {prompts('test', False)} FROM s",
    "pad_ids": "WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_concat(ids, [-1, -1, -1, -1, -1, -1])[1:6], ',') AS ids, array_to_string(list_transform(range(6), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS mask FROM l",
    "timestamp_text": "SELECT event_id, replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || '.123+08:00' AS stamp FROM events",
    "redact_prefix": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '.' ELSE page_id || ' ' || url END AS text FROM pages",
    "merge_global": f"{FULL} SELECT rec, ctx_pos, t_pos, h, r, t FROM merged",
    "merge_counters": f"{FULL} SELECT rec, count(*) AS seen, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("kept", "duplicate", "collision", "substring")) + " FROM st GROUP BY rec",
    "tail_in_head_filter": "WITH p AS (SELECT p_partkey AS rec, CAST(0 AS BIGINT) AS t_pos, p_name AS h, split_part(p_name, ' ', -1) AS t FROM part UNION ALL SELECT p_partkey, 1, p_name, 'Maker' FROM part) SELECT rec, t_pos, CASE WHEN contains(h, t) THEN 'substring' ELSE 'kept' END AS status FROM p",
    "pair_dedup": f"{BASE} SELECT rec, ctx_pos, t_pos, h, r, t FROM kg WHERE h <> t QUALIFY row_number() OVER (PARTITION BY rec, least(h, t), greatest(h, t) ORDER BY ctx_pos, t_pos) = 1",
    "pair_counters": f"{BASE}, c AS (SELECT rec, count(*) AS raw, count(*) FILTER (WHERE h = t) AS self_loops, count(DISTINCT (h, r, t)) FILTER (WHERE h <> t) AS d, count(DISTINCT (least(h, t), greatest(h, t))) FILTER (WHERE h <> t) AS kept FROM kg GROUP BY rec) SELECT rec, raw, self_loops, raw - self_loops - d AS duplicates, d - kept AS pair_repeats, kept FROM c",
    "edge_dedup": f"{BASE} SELECT DISTINCT rec, h, t FROM kg WHERE h <> t",
    "distinct_triples": f"{BASE} SELECT DISTINCT rec, h, r, t FROM kg",
    "run_groups": "WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS run FROM a), c AS (SELECT run, first(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM b GROUP BY run) SELECT CAST(run AS BIGINT) AS run, event_type, first, last, size, row_number() OVER (PARTITION BY event_type ORDER BY run) > 1 AS recurrence FROM c",
    "run_stats": "WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS run FROM a), c AS (SELECT run, first(event_type) AS v, count(*) AS size FROM b GROUP BY run), e AS (SELECT v, count(*) AS k, max(size) AS m FROM c GROUP BY v) SELECT CAST(sum(k) AS BIGINT) AS segments, max(m) AS max_segment, count(*) AS unique_values, count(*) FILTER (WHERE k > 1) AS non_contiguous FROM e",
    "regroup_runs": f"{RUNS}, c AS (SELECT event_id, g, row_number() OVER (PARTITION BY g ORDER BY event_id) - 1 AS place FROM b WHERE g < 500) SELECT event_id, g AS \"group\", place, 'regrouped-' || lpad(CAST(g AS VARCHAR), 6, '0') || '-doc-' || lpad(CAST(place AS VARCHAR), 2, '0') AS id FROM c WHERE place < 2",
    "regroup_counts": f"{RUNS}, c AS (SELECT g, first(event_type) AS v, count(*) AS n FROM b GROUP BY g), e AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY g) > 1 AS again FROM c) SELECT count(*) AS groups, CAST(sum(least(n, 2)) AS BIGINT) AS documents, CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS skipped, count(*) FILTER (WHERE again) AS repeated_groups FROM e",
    "contiguity": "SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1",
    "dup_ctx_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "min_by_key": "SELECT o_orderpriority AS key, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1",
    "first_map_wins": "SELECT conv_id, role AS key, turn AS value, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY pos) = 1",
    "select_unique": f"{unique(42, 50)} SELECT rank, key, priority, \"index\" FROM x WHERE rank <= 50",
    "train_eval_split": f"{unique(43, 60)} SELECT rank, \"index\", CASE WHEN rank <= 40 THEN 'train' ELSE 'eval' END AS split FROM x WHERE rank <= 60",
    "exclude_questions": f"SELECT doc_id, source FROM documents WHERE coalesce({QUESTION} NOT IN (SELECT {QUESTION} FROM benchmark WHERE text IS NOT NULL), TRUE)",
    "hash_sample": f"{FULL} SELECT rec, pos, sampled FROM drawn",
    "topk_contexts": "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS id FROM conversations WHERE turn % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
    "shard_ranges": "SELECT CAST(floor(doc_id / 250) AS BIGINT) AS shard, min(doc_id) AS start, count(*) AS count FROM documents GROUP BY 1",
    "worst_mismatches": "SELECT o_custkey AS \"index\", count(*) AS missing FROM orders GROUP BY 1 ORDER BY missing DESC, 1 LIMIT 20",
    "positional_zip": "SELECT CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS status, count(*) AS n FROM documents a FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT max(doc_id) + 1 FROM documents) b ON a.doc_id = b.doc_id GROUP BY 1",
    "localize": f"{LOC} SELECT rec, ctx_pos, t_pos, h, r, t FROM ls",
    "localized_lists": f"{LOC} SELECT rec, ctx_pos, string_agg({neutral()}, '' ORDER BY t_pos) AS items FROM lp GROUP BY ALL",
    "edge_anti_join": f"{FULL} SELECT rec, count(*) AS n FROM kg WHERE NOT EXISTS (SELECT 1 FROM pri WHERE pri.rec = kg.rec AND pri.h = kg.h AND pri.t = kg.t) GROUP BY rec",
    "qa_pairs": "SELECT c_nationkey AS rec, c_name AS entity, s_name AS answer FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 9 <> 0",
    "relation_tail_conflict": f"{FULL} SELECT DISTINCT rec, h, r, t FROM pub WHERE EXISTS (SELECT 1 FROM pri p WHERE p.rec = pub.rec AND p.r = pub.r AND p.t = pub.t AND {ALIKE.format('p.h', 'pub.h')})",
    "log_merge": f"SELECT event_id + 1 AS step, CAST({LOGP} AS BIGINT) AS p, {STAMP} AS reward_timestamp, CAST({n1000(7)} AS DOUBLE) AS mean_reward, CAST({n1000(11)} AS DOUBLE) AS mean_r_pub, CAST({n1000(13)} AS DOUBLE) AS mean_r_pri, CAST(1e-05 AS DOUBLE) AS learning_rate, {STAMP} AS update_timestamp, CAST({n1000(17)} AS DOUBLE) AS update_seconds, -CAST({n1000(19)} AS DOUBLE) AS kl FROM events",
    "log_regex": f"SELECT event_id * 2 AS line, event_id + 1 AS step, CAST(NULL AS DOUBLE) AS kl FROM events UNION ALL SELECT event_id * 2 + 1, event_id + 1, -CAST({n1000(19)} AS DOUBLE) FROM events",
    "set_sizes": f"{FULL}, {PRED}, e AS (SELECT rec, h, r, t, max(p) AS p, max(q) AS q FROM (SELECT rec, h, r, t, 1 AS p, 0 AS q FROM pred UNION ALL SELECT rec, h, r, t, 0, 1 FROM pri) GROUP BY ALL), s AS (SELECT rec, CAST(sum(p * q) AS BIGINT) AS \"both\", count(*) AS either, CAST(sum(p * (1 - q)) AS BIGINT) AS extra, CAST(sum((1 - p) * q) AS BIGINT) AS missing FROM e GROUP BY rec) SELECT *, \"both\" > 0 AS overlap, missing = 0 AS covers FROM s",
    "train_eval_overlap": "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "local_not_global": f"{FULL} SELECT rec, count(DISTINCT (kg.h, kg.r, kg.t)) FILTER (WHERE NOT EXISTS (SELECT 1 FROM pub p WHERE p.rec = kg.rec AND p.h = kg.h AND p.r = kg.r AND p.t = kg.t)) AS absent FROM kg WHERE rec IN (SELECT rec FROM pub) GROUP BY rec",
    "components": f"{FULL}, {reach('g', 'SELECT rec, h AS u, t AS v FROM pri', 'rec')} SELECT rec, src AS node, min(node) AS comp FROM g GROUP BY ALL",
    "reachable_pairs": f"{FULL}, {reach('g', 'SELECT rec, h AS u, t AS v FROM pri', 'rec')} {connected('SELECT rec, h AS a, t AS b FROM pub', 'g', 'rec')}",
    "leak_filter": f"{FULL}, {reach('g', 'SELECT rec, h AS u, t AS v FROM pub', 'rec')}, c AS ({connected('SELECT rec, h AS a, t AS b FROM pri', 'g', 'rec')}) SELECT rec, pos, h, r, t FROM pri WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rec = pri.rec AND c.a = pri.h AND c.b = pri.t)",
    "promote_closure": closure(ROUNDS),
    "promote_round": f"{FULL}, {reach('g', 'SELECT rec, h AS u, t AS v FROM pri', 'rec')}, c AS ({connected('SELECT rec, h AS a, t AS b FROM pub', 'g', 'rec')}), m AS (SELECT DISTINCT rec, h, r, t, CAST(EXISTS (SELECT 1 FROM pri p WHERE p.rec = pub.rec AND p.r = pub.r AND p.t = pub.t AND {ALIKE.format('p.h', 'pub.h')}) AS INT) AS conflict, CAST(EXISTS (SELECT 1 FROM c WHERE c.rec = pub.rec AND c.a = pub.h AND c.b = pub.t) AS INT) AS path FROM pub) SELECT * FROM m WHERE conflict + path > 0",
    "d_special": f"{LOC}, s AS (SELECT DISTINCT rec, ctx_pos FROM lp WHERE EXISTS (SELECT 1 FROM ls WHERE ls.rec = lp.rec AND ls.ctx_pos = lp.ctx_pos AND ls.t = lp.t) AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.rec = lp.rec AND ls.ctx_pos = lp.ctx_pos AND ls.t = lp.t AND ls.h = lp.h AND ls.r = lp.r)) SELECT rec, count(*) AS special FROM s GROUP BY rec HAVING count(*) >= 2",
    "special_contexts": f"{LOC} SELECT DISTINCT rec, ctx_pos FROM lp WHERE EXISTS (SELECT 1 FROM ls WHERE ls.rec = lp.rec AND ls.ctx_pos = lp.ctx_pos AND ls.t = lp.t) AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.rec = lp.rec AND ls.ctx_pos = lp.ctx_pos AND ls.t = lp.t AND ls.h = lp.h AND ls.r = lp.r)",
    "inference_attack": f"""{LOC}, pe AS (SELECT DISTINCT rec, h, t FROM pri), ue AS (SELECT DISTINCT rec, h, t FROM (FROM pub UNION ALL FROM pri) EXCEPT FROM pe),
mine AS (SELECT DISTINCT rec, ctx_pos, h, t FROM ls), docs AS (SELECT DISTINCT rec, ctx_pos FROM mine),
ou AS (SELECT DISTINCT rec, ctx_pos, h, t FROM kg EXCEPT FROM mine),
a AS (SELECT d.rec, d.ctx_pos, h AS u, t AS v FROM docs d JOIN ue USING (rec) EXCEPT FROM ou),
b AS (SELECT d.rec, d.ctx_pos, h AS u, t AS v FROM docs d JOIN pe USING (rec) EXCEPT FROM mine),
{reach('ga', 'FROM a', 'rec, ctx_pos')}, {reach('gb', 'FROM b', 'rec, ctx_pos')},
ca AS ({connected('SELECT rec, ctx_pos, h AS a, t AS b FROM mine', 'ga', 'rec, ctx_pos')}), cb AS ({connected('SELECT rec, ctx_pos, h AS a, t AS b FROM mine', 'gb', 'rec, ctx_pos')})
SELECT DISTINCT rec FROM (FROM ca EXCEPT FROM cb)""",
    "retention": f"{REF} SELECT rec, ctx_pos, n_pub, n_pri, round(r_pub, 9) AS r_pub, round(r_pri, 9) AS r_pri FROM r",
    "retention_macro": f"{REF} SELECT count(*) AS documents, round(avg(r_pub), 9) AS r_pub, round(avg(r_pri), 9) AS r_pri, count(*) FILTER (WHERE n_pub = 0) AS empty_public, count(*) FILTER (WHERE n_pri = 0) AS empty_private FROM r",
    "recall_report": f"{REF}, z AS (SELECT count(*) AS samples, round(sum(k_pub) / sum(n_pub), 9) AS public_micro, round(sum(k_pri) / sum(n_pri), 9) AS private_micro, round(avg(k_pub / nullif(n_pub, 0)), 9) AS public_macro, round(avg(k_pri / nullif(n_pri, 0)), 9) AS private_macro, count(*) FILTER (WHERE n_pub + n_pri > 0 AND k_pub + k_pri = 0) AS zero_match, count(*) FILTER (WHERE n_pub + n_pri = k_pub + k_pri) AS fully_recovered, count(*) FILTER (WHERE n_pub + n_pri > k_pub + k_pri) AS mismatch FROM r) SELECT *, CASE WHEN least(public_micro, private_micro, public_macro, private_macro) >= 0.8 THEN 'pass' ELSE 'fail' END AS gate_status FROM z",
    "connectivity": f"{FULL}, {PRED}, {reach('g', 'SELECT rec, h AS u, t AS v FROM pred WHERE h <> t', 'rec')}, c AS ({connected('SELECT rec, h AS a, t AS b FROM pri', 'g', 'rec')}), k AS (SELECT pri.rec, count(*) AS n, count(c.a) AS k FROM pri LEFT JOIN c ON c.rec = pri.rec AND c.a = pri.h AND c.b = pri.t GROUP BY 1) SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS private_triples, CAST(sum(k) AS BIGINT) AS connected, round(avg(k / n), 9) AS macro, round(sum(k) / sum(n), 9) AS micro FROM k",
    "summary_stats": "SELECT lang, count(n_chars) AS count, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 9) AS mean, round(median(n_chars), 9) AS median FROM documents GROUP BY lang",
    "phase_rollup": f"WITH e AS (SELECT event_id + 1 AS step, CAST({LOGP} AS BIGINT) AS p, CAST({n1000(7)} AS DOUBLE) AS a, CAST({n1000(11)} AS DOUBLE) AS b FROM events) SELECT coalesce(p, -1) AS p, min(step) AS first_step, max(step) AS last_step, count(*) AS n, round(avg(a), 9) AS reward, round(avg(b), 9) AS r_pub FROM e GROUP BY ROLLUP (p)",
    "tail_multimap": f"{FULL}, d AS (SELECT DISTINCT rec, t, h, r FROM pri) SELECT rec, t, count(*) AS n, string_agg(h || '/' || r, ';' ORDER BY h, r) AS pairs FROM d GROUP BY ALL",
    "skip_status": f"{LOC}, d AS (SELECT rec, count(DISTINCT ctx_pos) AS n, count(*) FILTER (WHERE NOT p) AS k FROM ll GROUP BY rec) SELECT CASE WHEN rec % 7 = 0 OR n - CAST(rec % 7 = 1 AS INT) = 0 THEN 'no_rewrites' WHEN rec % 7 = 1 THEN 'alignment_mismatch' WHEN k = 0 THEN 'empty_privacy' ELSE 'evaluated' END AS status, count(*) AS n FROM d GROUP BY 1",
    "validate_retrieved": r"""WITH c AS (SELECT conv_id % 10 AS m, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS e FROM conversations GROUP BY conv_id),
v AS (SELECT *, n = 4 AND m <> 5 AS ok FROM c)
SELECT count(*) AS records, CAST(coalesce(sum(n) FILTER (WHERE ok), 0) AS BIGINT) AS contexts,
 CAST(sum(CASE WHEN m = 5 THEN 1 ELSE CAST(m = 3 AS INT) + CAST(m = 4 AS INT) + CAST(NOT ok AS INT) + CASE WHEN ok THEN e + CAST(m = 1 AS INT) + CAST(m = 2 AS INT) ELSE 0 END END) AS BIGINT) AS invalid_records,
 coalesce(sum(CASE WHEN m IN (3, 4, 5) OR NOT ok OR e > 0 OR m IN (1, 2) THEN 1 ELSE 0 END), 0) = 0 AS valid FROM v""",
    "validate_sft": f"""{SFT_ROWS} SELECT count(*) AS records_total, count(*) FILTER (WHERE m BETWEEN 1 AND 5) AS records_with_errors, count(*) FILTER (WHERE m NOT BETWEEN 1 AND 5) AS records_valid, CAST(0 AS BIGINT) AS records_with_warnings,
  CAST(0 AS BIGINT) AS duplicate_global_public, CAST(0 AS BIGINT) AS duplicate_global_private, CAST(0 AS BIGINT) AS duplicate_local_public, CAST(0 AS BIGINT) AS duplicate_local_private,
  count(*) FILTER (WHERE whole AND a = 0) AS empty_global_public, count(*) FILTER (WHERE whole AND b = 0) AS empty_global_private,
  count(*) FILTER (WHERE whole AND m <> 4 AND a = 0) AS empty_local_public, count(*) FILTER (WHERE whole AND b = 0) AS empty_local_private, count(*) FILTER (WHERE m BETWEEN 1 AND 5) = 0 AS valid FROM d""",
    "sft_statistics": f"""{SFT_ROWS}, v AS (SELECT unnest([{{'m': 'text_chars', 'v': CASE WHEN m = 2 THEN 1 ELSE 4 END}}, {{'m': 'anonymized_text_chars', 'v': 10}}, {{'m': 'global_public_triples', 'v': a}}, {{'m': 'global_private_triples', 'v': b}},
  {{'m': 'local_public_triples', 'v': a + CASE WHEN m = 4 THEN 1 ELSE 0 END}}, {{'m': 'local_private_triples', 'v': b}}]) AS s FROM d WHERE whole) {STATISTICS}""",
    "sft_errors": f"""{SFT_ROWS} SELECT line, CAST(0 AS BIGINT) AS nth, CASE m WHEN 1 THEN 'private[' || b || ']' WHEN 2 THEN 'text' WHEN 4 THEN 'o_public' ELSE '<record>' END AS location,
  CASE m WHEN 1 THEN 'must contain exactly three items' WHEN 2 THEN 'must not be empty' WHEN 3 THEN 'missing fields: [''anonymized_text'']' WHEN 4 THEN '1 local public triples are absent from global public' ELSE 'invalid JSON' END AS message
  FROM d WHERE m BETWEEN 1 AND 5""",
    "sft_groups": f"""{SFT_ROWS}, o AS (SELECT line, fp, row_number() OVER (ORDER BY line) AS i, CASE WHEN fp = lag(fp) OVER (ORDER BY line) THEN 0 ELSE 1 END AS s FROM (SELECT line, x || CASE WHEN m = 1 THEN '+' ELSE '' END AS fp FROM d WHERE whole)),
  r AS (SELECT fp, count(*) AS n FROM (SELECT *, sum(s) OVER (ORDER BY line) AS g FROM o) GROUP BY fp, g), u AS (SELECT fp, count(*) AS k, max(n) AS n FROM r GROUP BY fp)
  SELECT CAST(sum(k) AS BIGINT) AS segments, max(n) AS max_segment, count(*) AS unique_values, count(*) FILTER (WHERE k > 1) AS non_contiguous FROM u""",
    "validate_rl": f"""{RL_ROWS},
e AS (SELECT rec, count(*) AS n FROM ({RL_ERRORS}) GROUP BY rec), c AS (SELECT count(DISTINCT rec) AS query_count, count(*) FILTER (WHERE m <> 4) AS document_count, count(*) FILTER (WHERE m <> 4 AND a = 0) AS empty_local_public,
  count(*) FILTER (WHERE m <> 4 AND b = 0) AS empty_local_private, round(avg(a) FILTER (WHERE m <> 4), 9) AS mean_local_public FROM d),
s AS (SELECT count(*) AS records_with_errors, CAST(coalesce(sum(n), 0) AS BIGINT) AS errors FROM e)
SELECT *, round(empty_local_public / document_count, 9) AS empty_local_public_ratio, round(empty_local_private / document_count, 9) AS empty_local_private_ratio, round(records_with_errors / query_count, 9) AS malformed_record_ratio, records_with_errors = 0 AS valid FROM c, s""",
    "rl_statistics": f"""{RL_ROWS}, v AS (SELECT unnest([{{'m': 'local_public_triples_per_document', 'v': a}}, {{'m': 'local_private_triples_per_document', 'v': b}}]) AS s FROM d WHERE m <> 4
  UNION ALL SELECT {{'m': 'contexts_per_query', 'v': count(*)}} FROM d WHERE m <> 4 GROUP BY rec) {STATISTICS}""",
    "rl_errors": f"""{RL_ROWS} SELECT rec AS line, row_number() OVER (PARTITION BY rec ORDER BY o) - 1 AS nth, location, message FROM ({RL_ERRORS})""",
    "metric_bounds": "SELECT event_type, count(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS want_n, event_type <> 'click' AND max(value / 20) BETWEEN 0 AND 1 AS valid FROM events GROUP BY event_type",
    "json_typed_scan": "SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' END AS kind, CAST(props->>'$.k' AS BIGINT) AS k, json_type(props, '$.k') = 'VARCHAR' AS is_text FROM events",
    "record_counts": "WITH c AS (SELECT 'a' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'b', count(*) FROM documents WHERE doc_id >= 0 UNION ALL SELECT 'c', count(*) FROM documents WHERE doc_id > 0) SELECT *, (SELECT min(n) = max(n) FROM c) AS conserved FROM c",
    "count_filter": f"{LOC} SELECT rec, ctx_pos FROM ll GROUP BY ALL HAVING count(*) FILTER (WHERE p) >= 5 AND count(*) FILTER (WHERE NOT p) >= 2",
    "flatten_examples": f"{LOC} SELECT rec, CAST(ctx_pos AS VARCHAR) AS text, count(*) FILTER (WHERE p) AS n_public, count(*) FILTER (WHERE NOT p) AS n_private FROM ll GROUP BY rec, ctx_pos HAVING count(*) FILTER (WHERE p) >= 3 AND count(*) FILTER (WHERE NOT p) >= 1",
    "hotpot_zip": f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations) SELECT conv_id, pos, 'chat:' || conv_id || ':' || (pos + 1) AS id, role AS title, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> ''), ' ')) AS digest FROM c WHERE pos < 3",
    "answers_distinct": "WITH f AS (SELECT user_id, event_type, arg_min(event_id % 2, event_id) AS odd, min(event_id) AS i FROM events GROUP BY ALL) SELECT user_id, string_agg(CASE WHEN odd = 0 THEN upper(event_type) ELSE event_type END, ',' ORDER BY i) AS answers FROM f GROUP BY user_id",
    "coref_identity": "SELECT conv_id, turn, sha256(text) AS digest, FALSE AS timed_out FROM conversations",
}


def positions(sizes: tuple[int, ...], share: int, seed: int) -> str:
    """The positions that the standard generator draws, for tables of these sizes."""
    return "CASE (SELECT count(*) FROM documents) " + " ".join(f"WHEN {n} THEN {random.Random(seed).sample(range(n), share)}" for n in sizes) + " END"


NAMES = "[A-Z][\\w''-]*(?: [A-Z][\\w''-]*)*"
ORACLES |= {
    "seeded_sample": f"SELECT doc_id FROM documents WHERE list_contains({positions((200, 1000, 10_000), 20, 42)}, doc_id)",
    "question_entities": rf"SELECT item_id, sum(coalesce(len(list_distinct(regexp_extract_all(regexp_replace(text, '\A(?:Who|What|When|Where|Which|Whose|Whom|Why|How|Is|Are|Was|Were|Did|Does|Do|In|On|The)\b', ''), '{NAMES}'))), 0))::BIGINT AS n FROM benchmark GROUP BY item_id",
    "template_rewrite": f"""{LOC}, x AS (SELECT rec, ctx_pos, coalesce(string_agg(h || ' ' || r || ' ' || t, '. ' ORDER BY t_pos) FILTER (WHERE NOT p), '') AS text,
  coalesce(list(t || chr(1) || '[' || r || ']' ORDER BY t_pos) FILTER (WHERE NOT p), []) AS swaps FROM ll GROUP BY rec, ctx_pos)
SELECT rec, ctx_pos, sha256(list_reduce(swaps, lambda a, s: replace(a, split_part(s, chr(1), 1), split_part(s, chr(1), 2)), text)) AS digest FROM x""",
}
