"""Queries of the engine's relational, ranking, retrieval, graph, series and fitting operators, and their SQL.

Every query runs over its whole tables. Floating-point results are rounded to 6 places in both.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.diagnostics import DIAGNOSTICS, Diagnostic, diagnose
from tessera.functions.text import norm_id, norm_name
from tessera.operators import fitting, graphs, relational, retrieval, series
from tessera.operators.components import components
from tessera.plans import diagnostics_sql
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def R(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


# --- relational


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, d):
    return relational.best_row(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def lateral_top1(spark, d):
    return relational.lateral_top1(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


_ID = lambda c: f"lower(regexp_replace({c}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g'))"
_NAME = lambda c: f"regexp_replace({c}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')"


@query(f"WITH a AS (SELECT DISTINCT {_ID('atom_id')} AS atom_id, {_NAME('fqdn')} AS fqdn FROM atoms) SELECT * FROM a WHERE atom_id <> '' AND fqdn <> '' AND atom_id IN (SELECT {_ID('atom_id')} FROM atom_versions) AND atom_id IN (SELECT {_ID('atom_id')} FROM io_specs) AND atom_id IN (SELECT {_ID('atom_id')} FROM hyperparams) AND fqdn IN (SELECT {_NAME('atom_fqdn')} FROM benchmarks) AND atom_id IN (SELECT {_ID('atom_id')} FROM atom_snapshots)")
def five_semi_joins(spark, d):
    by_id = lambda n: table(spark, d, n).select(norm_id(F.col("atom_id")).alias("atom_id"))
    atoms = table(spark, d, "atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), norm_name(F.col("fqdn")).alias("fqdn")).distinct()
    measured = table(spark, d, "benchmarks").select(norm_name(F.col("atom_fqdn")).alias("fqdn"))
    return relational.semi_all(atoms, [*[(by_id(n), "atom_id") for n in ("atom_versions", "io_specs", "hyperparams")], (measured, "fqdn"), (by_id("atom_snapshots"), "atom_id")])


@query("SELECT p.p_partkey, CASE WHEN q.p_partkey IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM part p LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS s FROM part WHERE p_partkey % 10 <> 0) q ON p.p_partkey = q.p_partkey WHERE q.p_partkey IS NULL OR q.s IS DISTINCT FROM p.p_size")
def stale_or_missing_anti(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    derived = p.where("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    return relational.missing_or_stale(p, derived, "p_partkey", ["p_size"]).select("p_partkey", "reason")


@query("SELECT c_custkey, src FROM (SELECT c_custkey, 1 AS p, 'all' AS src FROM customer UNION ALL SELECT o_custkey, 2, 'orders' FROM orders UNION ALL SELECT o_custkey, 3, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%') QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY p DESC, src DESC) = 1")
def union_precedence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return relational.union_by_precedence([(table(spark, d, "customer").select("c_custkey", F.lit("all").alias("src")), 1), (o.withColumn("src", F.lit("orders")), 2), (o.where("o_orderpriority LIKE '1%'").withColumn("src", F.lit("urgent")), 3)], "c_custkey", "src")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_count FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def leaderboard_page(spark, d):
    return relational.page_with_total(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 10)


@query("SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_ordered_document(spark, d):
    kids = relational.nested_children(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_linenumber", "l_partkey", "l_returnflag"], "lines")
    out = table(spark, d, "orders").select("o_orderkey").join(kids.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"], s["l_returnflag"])), ",").alias("lines"), F.size("lines").cast("bigint").alias("n_lines"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_keys_and_props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def coverage_grouping_sets(spark, d):
    out = relational.grouping_sets(table(spark, d, "lineitem"), [[], ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], [F.count(F.lit(1)).alias("n"), R(F.sum("l_quantity")).alias("qty")])
    return out.select("l_returnflag", "l_linestatus", _big("grouping_id"), "n", "qty")


@query("WITH b AS (SELECT o_orderkey, o_orderdate, o_totalprice, 0 AS w FROM orders UNION ALL SELECT o_orderkey, o_orderdate + CAST((o_orderkey % 3) - 1 AS INT) * INTERVAL 1 DAY, o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, o_orderdate, o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, w DESC) = 1")
def upsert_last_writer(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    changes = o.where("o_orderkey % 2 = 0").withColumns({"o_orderdate": F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 3 AS INT) - 1)"), "o_totalprice": F.col("o_totalprice") * 2})
    return relational.upsert(o, changes, "o_orderkey", "o_orderdate")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def keep_last_n(spark, d):
    return relational.keep_last_n(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


@query("SELECT DISTINCT atom_id, substr(sha256(concat_ws(chr(10), nullif(fqdn, ''), nullif(description, ''), nullif(domain_tags, ''))), 1, 16) AS input_hash FROM atoms")
def embedding_input_hash(spark, d):
    text = F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("fqdn", "description", "domain_tags")])
    return table(spark, d, "atoms").select("atom_id", F.substring(F.sha2(text, 256), 1, 16).alias("input_hash")).distinct()


@query("SELECT c_custkey, CAST(list_sum(list_transform(string_split(sha256('b1:' || c_custkey), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 AS BIGINT) AS part FROM customer")
def hash_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", relational.hash_split(F.col("c_custkey").cast("string"), F.lit("b1")).cast("bigint").alias("part"))


@query("SELECT l_suppkey AS s, CAST(max(CASE WHEN l_quantity >= rn THEN rn ELSE 0 END) AS BIGINT) AS h_index FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rn FROM lineitem) GROUP BY 1")
def h_index(spark, d):
    return relational.h_index(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), "l_quantity"), "s", "l_quantity")


@query("WITH p AS (SELECT user_id, event_type, count(*) AS pulls, avg(value / 500) AS mean FROM events GROUP BY ALL) SELECT user_id, event_type, pulls, round(mean, 9) AS mean, round(mean + 1.414 * sqrt(ln(sum(pulls) OVER (PARTITION BY user_id)) / pulls), 6) AS ucb FROM p")
def ucb1_rank(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("value") / 500).alias("r"))
    return relational.ucb1(e, "user_id", "event_type", "r").select("user_id", "event_type", "pulls", R("mean", 9).alias("mean"), R("ucb").alias("ucb"))


@query("SELECT event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def best_so_far(spark, d):
    return relational.best_so_far(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "best", "improved")


@query("SELECT p_partkey, round(greatest(0, least(1, (2000 - p_retailprice) / 1100.0)), 6) AS reward FROM part")
def reward_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", R(relational.min_max_reward(F.col("p_retailprice"), F.lit(900.0), F.lit(2000.0))).alias("reward"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) * 100, 6) AS share FROM lineitem")
def gradient_share(spark, d):
    return relational.share_of_total(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", R("share").alias("share"))


@query("WITH t AS (SELECT p_retailprice a, max(p_size) b FROM part GROUP BY 1), g AS (SELECT a, b FROM (SELECT a, b, max(b) OVER (ORDER BY a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM t) WHERE m IS NULL OR b > m) SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part JOIN g ON a = p_retailprice AND b = p_size")
def pareto_front(spark, d):
    return relational.pareto_front(table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_partkey", "p_retailprice", "p_size")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def bonus_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def bonus_intersect(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def bonus_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT event_id, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC)")
def bonus_ranks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("value").desc())
    return table(spark, d, "events").select("event_id", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.ntile(4).over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).cast("bigint").alias("q"))


@query("SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def bonus_as_of_join(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return relational.as_of_join(views, buys, "user_id", "ts", "ts", "last_purchase").select("event_id", "last_purchase")


@query("WITH r AS (SELECT p_partkey AS r, CAST(p_size * 10 AS DOUBLE) AS a, CAST(p_size * 10 + 5 AS DOUBLE) AS b FROM part) SELECT event_id, count(*) AS n FROM events JOIN r ON value >= a AND value < b GROUP BY 1")
def bonus_range_join(spark, d):
    r = table(spark, d, "part").groupBy((F.col("p_size") * 10).cast("double").alias("a"), (F.col("p_size") * 10 + 5).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return relational.range_join(table(spark, d, "events").select("event_id", "value"), r, "value", "a", "b", 10.0).groupBy("event_id").agg(F.sum("c").alias("n"))


# --- retrieval

_ASK = "kalman filter threshold"
_SYN = {"kalman": ["particle"], "filter": ["lowpass", "highpass"]}


def _fts_sql(bonus: str, asked: list[str], wide: list[str]) -> str:
    lit = lambda ts: "(" + ", ".join(f"'{t}'" for t in ts) + ")"
    return f"""WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents),
 f AS (SELECT token, ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)) AS idf FROM p WHERE token IN {lit(wide)} GROUP BY 1)
SELECT doc_id, round(sum(idf) + CASE WHEN count(*) FILTER (token IN {lit(asked)}) = {len(asked)} THEN {bonus} ELSE 0 END, 6) AS score FROM p JOIN f USING (token) GROUP BY doc_id"""


_ASKED = _ASK.split()


@query(_fts_sql("0", _ASKED, _ASKED))
def fts_any_token(spark, d):
    return retrieval.fts(table(spark, d, "documents"), "doc_id", "text", _ASK, 0.0).select("doc_id", R("score").alias("score"))


@query(_fts_sql("1.0", _ASKED, _ASKED))
def fts_strict_bonus(spark, d):
    return retrieval.fts(table(spark, d, "documents"), "doc_id", "text", _ASK).select("doc_id", R("score").alias("score"))


@query(_fts_sql("1.0", _ASKED, [*_ASKED, "particle", "lowpass", "highpass"]))
def query_synonym_expansion(spark, d):
    return retrieval.fts(table(spark, d, "documents"), "doc_id", "text", _ASK, 1.0, _SYN).select("doc_id", R("score").alias("score"))


@query("WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)), 6) AS idf FROM p GROUP BY 1")
def idf_table(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.idf(retrieval.postings(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n"))).select("token", "df", R("idf").alias("idf"))


_SIM = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS key, round({_SIM}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SIM}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def vector_topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.vector_top_k(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, 64).select("query", "key", R("similarity").alias("similarity"), "rank")


def _query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"SELECT b.vec_id, round({_SIM}, 6) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b WHERE {_SIM} >= 0.1")
def vector_threshold(spark, d):
    return retrieval.similar_to(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 0.1).select("vec_id", R("similarity").alias("similarity"))


@query(f"SELECT a.vec_id AS query, b.vec_id AS key, round({_SIM}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND {_SIM} >= 0.1")
def vector_threshold_all(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.vector_at_least(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.1, 64).select("query", "key", R("similarity").alias("similarity"))


#: Hits of each side that a fused search ranks.
POOL = 200


def _hybrid(spark, d):
    f = fts_any_token(spark, d)
    v = retrieval.similar_to(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d)).select(F.col("vec_id").alias("doc_id"), R("similarity").alias("score"))
    # the best of each side come first, so only these are ranked in one task
    return retrieval.rrf([(retrieval.top_k(x, "score", "doc_id", POOL), 1.0) for x in (f, v)], "doc_id")


_RRF = f"""f AS ({_fts_sql("0", _ASKED, _ASKED)}),
 fr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM f QUALIFY r <= {POOL}),
 v AS (SELECT b.vec_id AS doc_id, round({_SIM}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b),
 vr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v QUALIFY r <= {POOL}),
 h AS (SELECT coalesce(fr.doc_id, vr.doc_id) AS doc_id, coalesce(1.0 / (60 + fr.r), 0) + coalesce(1.0 / (60 + vr.r), 0) AS score FROM fr FULL JOIN vr ON fr.doc_id = vr.doc_id)"""


@query(f"WITH {_RRF} SELECT doc_id, round(score, 6) AS score FROM h")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("doc_id", R("score").alias("score"))


@query(f"WITH {_RRF}, t AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h) SELECT a.doc_id, a.rank, round(a.score - b.score, 6) AS lead, coalesce(a.score - b.score >= 0.0001, TRUE) AS accepted FROM t a LEFT JOIN t b ON b.rank = 2 WHERE a.rank = 1")
def rerank_margin(spark, d):
    top = retrieval.top_k(_hybrid(spark, d).withColumn("s9", R("score", 9)), "s9", "doc_id", 2)
    return retrieval.margin_abstain(top, "score", 0.0001).select("doc_id", "rank", R("lead").alias("lead"), "accepted")


@query(f"WITH k AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SIM}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10), t AS (SELECT a.vec_id AS query, b.vec_id AS key FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), b AS (SELECT query, min(rank) AS r FROM k JOIN t USING (query, key) GROUP BY 1) SELECT round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT DISTINCT query FROM t) LEFT JOIN b USING (query)")
def recall_mrr(spark, d):
    e = table(spark, d, "embeddings")
    hits = retrieval.vector_top_k(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, 64)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    truth = q.join(e.select(F.col("vec_id").alias("key"), "label"), "label").where("query <> key").select("query", "key")
    return retrieval.recall_and_mrr(hits, truth, "query", "key").select(R("recall").alias("recall"), R("mrr").alias("mrr"))


@query("WITH a AS (SELECT DISTINCT fqdn, description FROM atoms), s AS (SELECT fqdn, len(list_intersect(['kalman', 'filter', 'threshold'], regexp_extract_all(lower(concat_ws(' ', replace(replace(fqdn, '.', ' '), '_', ' '), description)), '[a-z0-9_]+'))) AS n, contains(lower(fqdn), 'kalman filter threshold') AS c FROM a) SELECT fqdn, round(CAST(n + n / 3.0 + CASE WHEN c THEN 4.0 ELSE 0 END AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY n DESC, fqdn DESC) AS rank FROM s ORDER BY n DESC, fqdn DESC LIMIT 25")
def lexical_rank(spark, d):
    a = table(spark, d, "atoms").select("fqdn", "description").distinct()
    return retrieval.lexical_rank(a, "fqdn", "description", _ASK, 25).select("fqdn", R("score").alias("score"), "rank")


@query("WITH t AS (SELECT doc_id, coalesce(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), []) AS w FROM documents) SELECT doc_id, round(len(list_intersect(w, ['kalman', 'filter', 'threshold'])) / 3.0, 6) AS overlap, round(len(list_intersect(w, ['kalman', 'filter', 'threshold'])) / CAST(len(list_distinct(list_concat(w, ['kalman', 'filter', 'threshold']))) AS DOUBLE), 6) AS jaccard FROM t WHERE len(list_intersect(w, ['kalman', 'filter', 'threshold'])) > 0")
def overlap_scores(spark, d):
    q = F.array(*map(F.lit, _ASKED))
    w = table(spark, d, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("w"))
    return w.where(F.arrays_overlap("w", q)).select("doc_id", R(retrieval.overlap(q, F.col("w"))).alias("overlap"), R(retrieval.jaccard(F.col("w"), q)).alias("jaccard"))


# --- graphs


def _edges(spark, d) -> DataFrame:
    n = table(spark, d, "cdg_nodes").select("node_id", "parent_id").distinct()
    return n.join(n.select(F.col("node_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("parent_id", "node_id")


_E = "e AS (SELECT DISTINCT n.parent_id, n.node_id FROM cdg_nodes n JOIN cdg_nodes p ON p.node_id = n.parent_id)"


@query(f"WITH RECURSIVE {_E}, n AS (SELECT parent_id AS node FROM e UNION SELECT node_id FROM e), t AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT node_id FROM e) UNION ALL SELECT e.node_id, t.level + 1 FROM e JOIN t ON e.parent_id = t.node) SELECT n.node, CAST(max(t.level) AS BIGINT) AS level FROM n LEFT JOIN t USING (node) GROUP BY 1")
def topo_levels(spark, d):
    return graphs.topo_levels(_edges(spark, d), "parent_id", "node_id")


@query(f"WITH RECURSIVE {_E}, t AS (SELECT parent_id AS from_node, node_id AS to_node FROM e UNION SELECT t.from_node, e.node_id FROM t JOIN e ON e.parent_id = t.to_node) SELECT from_node, to_node FROM t")
def transitive_closure(spark, d):
    return graphs.closure(_edges(spark, d), "parent_id", "node_id")


@query(f"WITH RECURSIVE {_E}, n AS (SELECT parent_id AS node FROM e UNION SELECT node_id FROM e), t AS (SELECT node FROM n WHERE node NOT IN (SELECT node_id FROM e) UNION ALL SELECT e.node_id FROM e JOIN t ON e.parent_id = t.node) SELECT count(*) AS n_nodes, count(*) FILTER (node NOT IN (SELECT node FROM t)) AS n_unplaced, count(*) FILTER (node NOT IN (SELECT node FROM t)) = 0 AS acyclic FROM n")
def has_cycle(spark, d):
    return graphs.has_cycle(_edges(spark, d), "parent_id", "node_id")


@query(f"WITH RECURSIVE {_E}, u AS (SELECT parent_id AS a, node_id AS b FROM e UNION SELECT node_id, parent_id FROM e), t AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b) SELECT a AS node, least(a, min(b)) AS component FROM t GROUP BY a")
def connected_components(spark, d):
    return components(_edges(spark, d), "parent_id", "node_id")


@query(f"WITH {_E} SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT parent_id AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT node_id, 1, 0 FROM e) GROUP BY 1")
def degree_sequence(spark, d):
    return graphs.degrees(_edges(spark, d), "parent_id", "node_id")


def _profiles(spark, d) -> DataFrame:
    n = table(spark, d, "cdg_nodes").select("node_id", "parent_id", "concept_type").distinct()
    return graphs.child_profile(n, "node_id", "parent_id", "concept_type")


_P = "p AS (SELECT parent_id AS node, count(*) AS n_children, list_sort(list(concept_type)) AS concepts FROM (SELECT DISTINCT node_id, parent_id, concept_type FROM cdg_nodes WHERE parent_id IS NOT NULL) GROUP BY 1)"
_ASKS = "CAST('0x' || substr(md5(node), 1, 8) AS BIGINT) % 100 = 0"


@query(f"""WITH {_P}, c AS (SELECT array_to_string(concepts, '|') AS profile, concepts, count(*) AS n_nodes, count(*) FILTER ({_ASKS}) AS n_queries FROM p GROUP BY ALL),
 s AS (SELECT q.profile AS query_profile, c.profile, q.n_queries, c.n_nodes, len(list_filter(q.concepts, lambda x: list_contains(c.concepts, x))) / CAST(len(q.concepts) + len(list_filter(c.concepts, lambda y: NOT list_contains(q.concepts, y))) AS DOUBLE) AS sim, len(list_intersect(q.concepts, c.concepts)) / CAST(len(list_distinct(list_concat(q.concepts, c.concepts))) AS DOUBLE) AS sets FROM c q, c WHERE q.n_queries > 0)
SELECT query_profile, profile, n_queries, n_nodes, round(sim, 6) AS similarity, round(sets, 6) AS set_similarity FROM s WHERE sim > 0.3""")
def jaccard_neighborhood(spark, d):
    """Child profiles that are like those of the query nodes (every hundredth by its id's hash): nodes of equal profile are one class."""
    asks = F.pmod(F.conv(F.substring(F.md5("node"), 1, 8), 16, 10).cast("bigint"), F.lit(100)) == 0
    return graphs.similar_profiles(_profiles(spark, d).withColumn("asks", asks), 0.3).select("query_profile", "profile", "n_queries", "n_nodes", R("similarity").alias("similarity"), R("set_similarity").alias("set_similarity"))


@query(f"WITH {_P} SELECT node, substr(sha256(array_to_string(concepts, '|')), 1, 16) AS topo_hash, n_children FROM p")
def structure_hash(spark, d):
    n = table(spark, d, "cdg_nodes").select("node_id", "parent_id", "concept_type").distinct()
    return graphs.structure_hash(n, "node_id", "parent_id", "concept_type")


@query("WITH n AS (SELECT DISTINCT node_id, concept_type, coalesce(len(inputs), 0) AS n_in, coalesce(len(outputs), 0) AS n_out FROM cdg_nodes), k AS (SELECT parent_id AS node_id, count(DISTINCT node_id) AS kids FROM cdg_nodes GROUP BY 1) SELECT node_id, n_in, n_out, kids FROM n JOIN k USING (node_id) WHERE concept_type = 'clustering' AND abs(n_in - 2) <= 1 AND abs(n_out - 1) <= 1 AND kids >= 2")
def structure_match_arity(spark, d):
    t = table(spark, d, "cdg_nodes")
    n = t.select("node_id", "concept_type", F.coalesce(F.size("inputs"), F.lit(0)), "inputs", "outputs").where("concept_type = 'clustering'")
    n = n.select("node_id", F.greatest(F.coalesce(F.size("inputs"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_in"), F.greatest(F.coalesce(F.size("outputs"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_out")).distinct()
    k = t.groupBy(F.col("parent_id").alias("node_id")).agg(F.countDistinct("node_id").alias("kids"))
    return n.where((F.abs(F.col("n_in") - 2) <= 1) & (F.abs(F.col("n_out") - 1) <= 1)).join(k, "node_id").where("kids >= 2")


@query(f"WITH s AS (SELECT DISTINCT snapshot_date AS d, nullif({_ID('atom_id')}, '') AS atom_id, fqdn, status FROM atom_snapshots WHERE (snapshot_date, delivered_at) IN (SELECT snapshot_date, max(delivered_at) FROM atom_snapshots GROUP BY 1)), a AS (SELECT * FROM s WHERE d = (SELECT min(d) FROM s)), b AS (SELECT * FROM s WHERE d = (SELECT max(d) FROM s)), u AS (SELECT atom_id, min(fqdn) AS f, min(status) AS st FROM a GROUP BY 1), v AS (SELECT atom_id, min(fqdn) AS f, min(status) AS st FROM b GROUP BY 1), j AS (SELECT coalesce(u.atom_id, v.atom_id) AS atom_id, CASE WHEN u.atom_id IS NULL THEN 'added' WHEN v.atom_id IS NULL THEN 'removed' WHEN u.f IS DISTINCT FROM v.f OR u.st IS DISTINCT FROM v.st THEN 'changed' END AS change FROM u FULL JOIN v ON u.atom_id = v.atom_id) SELECT atom_id, change FROM j WHERE change IS NOT NULL AND atom_id IS NOT NULL")
def graph_diff(spark, d):
    t = table(spark, d, "atom_snapshots").withColumn("atom_id", norm_id(F.col("atom_id"))).where("atom_id IS NOT NULL")
    ends = t.agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b")).first()
    last = table(spark, d, "atom_snapshots").groupBy("snapshot_date").agg(F.max("delivered_at").alias("delivered_at"))
    t = t.join(F.broadcast(last), ["snapshot_date", "delivered_at"])  # one row per date
    side = lambda x: t.where(F.col("snapshot_date") == F.lit(x)).groupBy("atom_id").agg(F.min("fqdn").alias("fqdn"), F.min("status").alias("status"))
    return graphs.graph_diff(side(ends["a"]), side(ends["b"]), "atom_id", ["fqdn", "status"])


@query("WITH n AS (SELECT DISTINCT node_id, parent_id FROM cdg_nodes) SELECT 'dangling' AS kind, parent_id AS id, count(*) AS n FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM n) GROUP BY 2 UNION ALL SELECT 'duplicate', node_id, count(*) FROM cdg_nodes GROUP BY 2 HAVING count(*) > 1")
def graph_dangling(spark, d):
    t = table(spark, d, "cdg_nodes").select("node_id", "parent_id")
    return graphs.dangling(t, t.distinct(), "node_id", "parent_id")


# --- series


def _series(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("v"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("bigint") - 1)


_S = "s AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
_RUNS = "r0 AS (SELECT *, v >= 20 AS o, v >= 20 IS DISTINCT FROM lag(v >= 20) OVER (PARTITION BY user_id ORDER BY pos) AS e FROM s), r1 AS (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM r0), r AS (SELECT user_id, g, min(pos) AS first, max(pos) AS last, count(*) AS length FROM r1 WHERE o GROUP BY 1, 2)"


@query(f"WITH {_S}, {_RUNS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY g) AS region, first, last, length FROM r")
def contiguous_regions(spark, d):
    return series.runs(_series(spark, d), "user_id", "pos", F.col("v") >= 20)


@query(f"WITH {_S}, {_RUNS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY g) AS region, first, last, length FROM r WHERE length >= 3")
def regionize_min_length(spark, d):
    return series.runs(_series(spark, d), "user_id", "pos", F.col("v") >= 20, 3)


def _intervals(spark, d) -> DataFrame:
    return _series(spark, d).where("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), (F.col("t") + F.col("v") * 600).alias("b"))


_I = "i AS (SELECT user_id, t AS a, t + v * 600 AS b FROM s WHERE event_type = 'purchase'), m0 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i), m1 AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a) AS g FROM m0), m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM m1 GROUP BY user_id, g)"


@query(f"WITH {_S}, {_I} SELECT user_id, round(a, 3) AS a, round(b, 3) AS b FROM m")
def merge_intervals(spark, d):
    return series.merge_intervals(_intervals(spark, d), "user_id", "a", "b").select("user_id", R("a", 3).alias("a"), R("b", 3).alias("b"))


@query(f"WITH {_S}, {_I} SELECT user_id, round(sum(b - a) / 3600, 4) AS hours FROM m GROUP BY 1")
def analyzed_time_hours(spark, d):
    return series.hours_covered(_intervals(spark, d), "user_id", "a", "b").select("user_id", R("hours", 4).alias("hours"))


@query(f"WITH {_S}, {_I}, h AS (SELECT user_id, sum(b - a) / 3600 AS hours FROM m GROUP BY 1) SELECT user_id, round(count(*) / hours, 4) AS rate FROM s JOIN h USING (user_id) GROUP BY user_id, hours")
def event_rate_per_hour(spark, d):
    h = series.hours_covered(_intervals(spark, d), "user_id", "a", "b")
    n = _series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(h, "user_id").select("user_id", R(F.col("n") / F.col("hours"), 4).alias("rate"))


@query(f"WITH {_S} SELECT user_id, round((t + p) / 2, 3) AS at, round(3600 / (t - p), 4) AS rate FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM s) WHERE p IS NOT NULL")
def event_rate_intervals(spark, d):
    return series.event_rate(_series(spark, d), "user_id", "t", 3600.0).select("user_id", R("at", 3).alias("at"), R("rate", 4).alias("rate"))


@query(f"WITH {_S} SELECT event_id, round(sum(v) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM s")
def moving_average_zero_pad(spark, d):
    return series.moving_average(_series(spark, d), "user_id", "pos", "v", 5).select("event_id", R("smooth").alias("smooth"))


@query(f"WITH {_S}, b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s), x AS (SELECT b.event_id, y.v FROM b, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) k JOIN b y ON y.user_id = b.user_id AND y.pos = least(greatest(b.pos + k.o, 0), b.n - 1)) SELECT event_id, round(quantile_cont(v, 0.5), 6) AS median FROM x GROUP BY 1")
def moving_median(spark, d):
    return series.moving_median(_series(spark, d), "user_id", "pos", "v", 2).select("event_id", R("median").alias("median"))


@query(f"WITH {_S}, m AS (SELECT user_id, pos, v >= avg(v) OVER (PARTITION BY user_id) AS u FROM s), c AS (SELECT user_id, u <> lag(u) OVER (PARTITION BY user_id ORDER BY pos) AS x FROM m) SELECT user_id, count(*) FILTER (x) AS crossings FROM c GROUP BY 1")
def mean_crossings(spark, d):
    return series.mean_crossings(_series(spark, d), "user_id", "pos", "v")


@query(f"WITH {_S}, a AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM s), b AS (SELECT *, quantile_cont(dt, 0.5) OVER (PARTITION BY user_id) AS m FROM a), c AS (SELECT *, quantile_cont(abs(dt - m), 0.5) OVER (PARTITION BY user_id) AS mad FROM b), e AS (SELECT *, coalesce(abs(dt - m) <= 1.0 * mad, TRUE) AS ok FROM c), f AS (SELECT *, coalesce(lead(ok) OVER (PARTITION BY user_id ORDER BY t), TRUE) AS nx FROM e) SELECT user_id, round(t, 3) AS t FROM f WHERE ok OR nx")
def reject_outlier_intervals(spark, d):
    return series.reject_outlier_intervals(_series(spark, d), "user_id", "t", 1.0).select("user_id", R("t", 3).alias("t"))


@query(f"WITH {_S}, a AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY pos) AS dv FROM s), b AS (SELECT *, quantile_cont(dv, 0.5) OVER (PARTITION BY user_id) AS m FROM a), c AS (SELECT *, quantile_cont(abs(dv - m), 0.5) OVER (PARTITION BY user_id) AS mad FROM b) SELECT event_id, round(v - sum(CASE WHEN abs(dv - m) > 5 * mad THEN dv ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos), 6) AS smooth FROM c")
def remove_jumps(spark, d):
    return series.remove_jumps(_series(spark, d), "user_id", "pos", "v").select("event_id", R("smooth").alias("smooth"))


@query(f"WITH {_S} SELECT user_id, CAST(pos // 10 AS BIGINT) AS block, count(*) AS n, CASE WHEN count(*) < 4 THEN TRUE ELSE stddev_pop(v) >= 1e-10 AND coalesce(kurtosis_pop(v), 0) >= 1.5 END AS good FROM s GROUP BY 1, 2")
def quality_blocks(spark, d):
    return series.quality_blocks(_series(spark, d), "user_id", "pos", "v", 10)


@query(f"WITH {_S} SELECT event_id, round(CASE WHEN max(v) OVER (PARTITION BY user_id) > 0 THEN v / max(v) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS norm FROM s")
def normalize_max(spark, d):
    return series.normalize_max(_series(spark, d), "user_id", "v").select("event_id", R("norm").alias("norm"))


@query(f"WITH {_S}, q AS (SELECT user_id, quantile_cont(v, 0.95) AS q FROM s GROUP BY 1) SELECT event_id, round(CASE WHEN q > 0 THEN least(1, greatest(0, v / q)) ELSE 0 END, 6) AS norm FROM s JOIN q USING (user_id)")
def normalize_quantile(spark, d):
    return series.normalize_quantile(_series(spark, d), "user_id", "v").select("event_id", R("norm").alias("norm"))


_M = "EXISTS (SELECT 1 FROM i WHERE i.user_id = s.user_id AND s.t >= i.a - 60 AND s.t < i.b + 60)"


@query(f"WITH {_S}, {_I} SELECT event_id FROM s WHERE {_M}")
def mask_include(spark, d):
    return series.mask(_series(spark, d), _intervals(spark, d), "user_id", "t", "a", "b", 60, 60).select("event_id")


@query(f"WITH {_S}, {_I} SELECT event_id FROM s WHERE NOT {_M}")
def mask_exclude(spark, d):
    return series.mask(_series(spark, d), _intervals(spark, d), "user_id", "t", "a", "b", 60, 60, True).select("event_id")


@query(f"WITH {_S}, f AS (SELECT *, min(t) OVER (PARTITION BY user_id, event_type) AS f FROM s) SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY f, t) AS seq FROM f")
def merge_by_first_time(spark, d):
    s = _series(spark, d)
    return series.merge_by_first_time([s.where(F.col("event_type") == k) for k in ("click", "error", "purchase", "signup", "view")], "user_id", "t").select("event_id", "seq")


_G = "x AS (SELECT user_id, CAST(pos AS DOUBLE) * 2 AS t, v FROM s), g AS (SELECT user_id, unnest(range(CAST(floor(max(t) / 0.75) AS BIGINT) + 1)) * CAST(0.75 AS DOUBLE) AS t FROM x GROUP BY 1), b AS (SELECT g.user_id, g.t, floor(g.t / 2) * 2 AS t0, ceil(g.t / 2) * 2 AS t1 FROM g), z AS (SELECT b.*, p.v AS v0, n.v AS v1 FROM b JOIN x p ON p.user_id = b.user_id AND p.t = t0 JOIN x n ON n.user_id = b.user_id AND n.t = t1)"


@query(f"WITH {_S}, {_G} SELECT user_id, t, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM z")
def resample_linear(spark, d):
    x = _series(spark, d).select("user_id", (F.col("pos").cast("double") * 2).alias("t"), "v")
    return series.resample(x, "user_id", "t", "v", 0.75).select("user_id", "t", R("v").alias("v"))


@query(f"WITH {_S}, {_G} SELECT user_id, t, round(CASE WHEN t - t0 < t1 - t OR t0 = t1 THEN v0 ELSE v1 END, 6) AS v FROM z")
def resample_nearest(spark, d):
    x = _series(spark, d).select("user_id", (F.col("pos").cast("double") * 2).alias("t"), "v")
    return series.resample(x, "user_id", "t", "v", 0.75, "nearest").select("user_id", "t", R("v").alias("v"))


def _pad(kernel: str, expr: str):
    sql = f"WITH {_S} SELECT a.user_id, a.pos AS t, round(sum(CASE WHEN o.pos IS NULL THEN 0 ELSE o.v * ({expr}) END), 6) AS padded FROM s a LEFT JOIN s o ON o.event_type = 'purchase' AND o.user_id = a.user_id AND a.pos - o.pos >= 0 AND a.pos - o.pos < 5 GROUP BY 1, 2"

    def run(spark, d):
        s = _series(spark, d).select("user_id", F.col("pos").alias("t"), "v", "event_type")
        return series.pad(s.where("event_type = 'purchase'"), s, "user_id", "t", "v", 5.0, kernel).select("user_id", "t", R("padded").alias("padded"))

    QUERIES[f"pad_{kernel}"], SQL[f"pad_{kernel}"] = run, sql


_pad("constant", "1")
_pad("linear", "1 - (a.pos - o.pos) / 5.0")
_pad("exponential", "exp((a.pos - o.pos) / 5.0 * ln(0.01))")
_pad("gaussian", "exp(-0.5 * pow((a.pos - o.pos) / 5.0 * 30 / sqrt(5.0), 2))")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value")).alias("total")).select(F.col("_w.start").alias("w"), "event_type", "n", "total")


@query("SELECT b - o * INTERVAL 15 MINUTE AS w, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events), (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY 1")
def sliding_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("w"), "n")


@query(f"WITH {_S}, n AS (SELECT user_id, max(pos) + 1 AS n FROM s GROUP BY 1), w AS (SELECT user_id, unnest(range(CAST((n - 10) // 4 AS BIGINT) + 1)) AS win FROM n WHERE n >= 10) SELECT w.user_id, win AS window, round(avg(v), 6) AS mean FROM w JOIN s ON s.user_id = w.user_id AND s.pos >= win * 4 AND s.pos < win * 4 + 10 GROUP BY 1, 2")
def hop_windows(spark, d):
    return series.hop_windows(_series(spark, d).select("user_id", "pos", "v"), "user_id", "pos", "v", 10, 4).select("user_id", "window", R("mean").alias("mean"))


# --- fitting and evaluation

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_quantity, l_tax) c, corr(l_extendedprice, l_discount) d, corr(l_extendedprice, l_tax) e, corr(l_discount, l_tax) f FROM lineitem) SELECT round(16 / (4 + 2 * (a*a + b*b + c*c + d*d + e*e + f*f)), 6) AS pr FROM c")
def participation_ratio(spark, d):
    return fitting.participation_ratio(table(spark, d, "lineitem"), _COLS).select(R("pr").alias("pr"))


_FORMS = {"unit_price": "l_extendedprice / l_quantity", "net": "l_extendedprice * (1 - l_discount)", "taxed": "l_quantity * (1 + l_tax)"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, round(avg({e}), 4) AS constant, round(stddev_pop({e}) / abs(avg({e})), 6) AS cv FROM lineitem" for n, e in _FORMS.items()))
def invariant_cv(spark, d):
    return fitting.invariant_variation(table(spark, d, "lineitem"), _FORMS).select("name", R("constant", 4).alias("constant"), R("cv").alias("cv"))


@query("SELECT count(*) AS n, round(quantile_cont(abs(l_extendedprice - l_quantity * 1500) / greatest(abs(l_extendedprice), abs(l_quantity * 1500)), 0.5), 6) AS residual FROM lineitem")
def direct_residual(spark, d):
    return fitting.direct_residual(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity * 1500").select("n", R("residual").alias("residual"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem" for c in _COLS))
def validity_triage(spark, d):
    return fitting.ranges(table(spark, d, "lineitem"), _COLS)


@query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope FROM lineitem GROUP BY 1")
def loglog_order(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(R(fitting.log_log_slope(F.col("l_quantity"), F.col("l_extendedprice"))).alias("slope"))


@query("SELECT l_returnflag, round(avg(pow(l_quantity * 1500 - l_extendedprice, 2)), 2) AS mse, round(sqrt(avg(pow(l_quantity * 1500 - l_extendedprice, 2))), 4) AS rmse, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 4) AS mae FROM lineitem GROUP BY 1")
def eval_regression_losses(spark, d):
    t = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return fitting.regression_losses(t, ["l_returnflag"], "p", "l_extendedprice").select("l_returnflag", R("mse", 2).alias("mse"), R("rmse", 4).alias("rmse"), R("mae", 4).alias("mae"))


@query("WITH t AS (SELECT l_returnflag, l_discount * 10 AS p, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END AS y FROM lineitem), q AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS c FROM t) SELECT l_returnflag, round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 4) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(1 - avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS error FROM q GROUP BY 1")
def eval_binary_losses(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("p"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0).alias("y"))
    return fitting.binary_losses(t, ["l_returnflag"], "p", "y").select("l_returnflag", R("log_loss", 4).alias("log_loss"), R("brier").alias("brier"), R("accuracy").alias("accuracy"), R("error").alias("error"))


@query(f"WITH {_S}, p AS (SELECT * FROM s WHERE event_type = 'view'), r AS (SELECT user_id, t, v, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1, lead(v) OVER (PARTITION BY user_id ORDER BY t) AS v1 FROM s WHERE event_type = 'click') SELECT p.event_id, round(p.v, 6) AS predicted, round(r.v + (r.v1 - r.v) * (p.t - r.t) / (r.t1 - r.t), 6) AS reference FROM p JOIN r ON r.user_id = p.user_id AND p.t >= r.t AND p.t < r.t1")
def align_interpolate(spark, d):
    s = _series(spark, d)
    a = fitting.align(s.where("event_type = 'view'"), s.where("event_type = 'click'"), "user_id", "t", "v")
    ids = s.where("event_type = 'view'").select("user_id", "t", "event_id")
    return a.join(ids, ["user_id", "t"]).select("event_id", R("predicted").alias("predicted"), R("reference").alias("reference"))


# --- run and event logs


@query("SELECT run_id, status, last_update_at FROM pipeline_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY last_update_at DESC) = 1 ORDER BY last_update_at DESC, run_id LIMIT 50")
def list_runs(spark, d):
    last = relational.best_row(table(spark, d, "pipeline_runs"), ["run_id"], ["last_update_at"], ["status", "last_update_at"])
    return last.orderBy(F.col("last_update_at").desc_nulls_last(), "run_id").limit(50)


@query("SELECT pipeline, status, count(*) AS n, CAST(sum(events_count) AS BIGINT) AS events, round(avg(ended_at - started_at), 4) AS mean_s, round(max(ended_at - started_at), 4) AS max_s FROM (SELECT * FROM pipeline_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY last_update_at DESC) = 1) GROUP BY ALL")
def run_summary(spark, d):
    last = relational.best_row(table(spark, d, "pipeline_runs"), ["run_id"], ["last_update_at"], ["pipeline", "status", "events_count", "started_at", "ended_at"])
    s = F.col("ended_at") - F.col("started_at")
    return last.groupBy("pipeline", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("events_count").cast("bigint").alias("events"), R(F.avg(s), 4).alias("mean_s"), R(F.max(s), 4).alias("max_s"))


@query(f"WITH {_S}, x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY pos) AS nt, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS ne FROM s) SELECT event_type, count(*) AS n, count(*) FILTER (ne = 'error') AS failed, round(avg(nt - t), 4) AS mean_s, round(max(nt - t), 4) AS max_s FROM x WHERE nt IS NOT NULL GROUP BY 1")
def dispatch_latency(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("pos")
    x = _series(spark, d).withColumns({"nt": F.lead("t").over(w), "ne": F.lead("event_type").over(w)}).where("nt IS NOT NULL")
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ne") == "error", 1)).alias("failed"), R(F.avg(F.col("nt") - F.col("t")), 4).alias("mean_s"), R(F.max(F.col("nt") - F.col("t")), 4).alias("max_s"))


@query("SELECT benchmark_name, metric_name, count(*) AS n, count(*) FILTER (isnan(metric_value)) AS n_nan, count(*) FILTER (isinf(metric_value)) AS n_inf, round(avg(metric_value) FILTER (isfinite(metric_value)), 9) AS mean, round(min(metric_value) FILTER (isfinite(metric_value)), 6) AS low, round(max(metric_value) FILTER (isfinite(metric_value)), 6) AS high FROM benchmarks GROUP BY ALL")
def benchmark_summary(spark, d):
    v = F.col("metric_value")
    fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return table(spark, d, "benchmarks").groupBy("benchmark_name", "metric_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.isnan(v), 1)).alias("n_nan"), F.count(F.when(~F.isnan(v) & (F.abs(v) == float("inf")), 1)).alias("n_inf"), R(F.avg(fine), 9).alias("mean"), R(F.min(fine)).alias("low"), R(F.max(fine)).alias("high"))


# --- numeric diagnostics


def _diag_base(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    return e.select(F.col("user_id").alias("g"), pos.alias("pos"), F.col("value").alias("x"), ((F.col("event_id") * 7) % 101 / 10.0 + 0.05).cast("double").alias("y"), (F.col("value") - 20).alias("z"), (F.col("event_id") % 13).alias("i"), (F.col("event_id") % 11).alias("j"), (F.col("event_type") != "error").alias("b"), F.col("event_type").alias("k"))


_DIAG = "SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x, CAST((event_id * 7) % 101 AS DOUBLE) / 10.0 + 0.05 AS y, value - 20 AS z, event_id % 13 AS i, event_id % 11 AS j, event_type <> 'error' AS b, event_type AS k FROM events"


def _diag(d: Diagnostic):
    def run(spark, root):
        return diagnose(_diag_base(spark, root), d).select("g", R("metric").alias("metric"), "flag")

    return run


for _d in DIAGNOSTICS:
    QUERIES[_d.key], SQL[_d.key] = _diag(_d), diagnostics_sql.sql(f"{_d.family}_{_d.name}", _DIAG)
