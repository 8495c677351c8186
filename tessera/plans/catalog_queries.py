"""Queries of the catalog, matrix, signal and stream operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import catalog, fitting, signals
from tessera.operators.components import components
from tessera.plans.reference_queries import _E, _DIAG, R, _diag_base, _edges
from tessera.session import shared_dir
from tessera.sources.tables import table
from tessera.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_LEAF = r"^.*\."


@query(r"""WITH k AS (SELECT DISTINCT atom_fqdn AS k FROM benchmarks WHERE atom_fqdn IS NOT NULL), t AS (SELECT DISTINCT fqdn AS t FROM atoms WHERE fqdn IS NOT NULL),
 m AS (SELECT k, 0 AS i, t FROM k JOIN t ON k = t UNION ALL SELECT k, 1, t FROM k JOIN t ON lower(trim(k)) = lower(trim(t)) UNION ALL SELECT k, 2, t FROM k JOIN t ON regexp_replace(lower(trim(k)), '^.*\.', '') = regexp_replace(lower(trim(t)), '^.*\.', '')),
 b AS (SELECT k, i, count(*) AS n, min(t) AS t FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1)
SELECT k.k AS atom_fqdn, CAST(i AS BIGINT) AS tier, CASE WHEN n = 1 THEN t END AS target, coalesce(n, 0) AS n FROM k LEFT JOIN b ON b.k = k.k""")
def tiered_match(spark, d):
    low = lambda c: F.lower(F.trim(c))
    return catalog.tiered_match(table(spark, d, "benchmarks"), table(spark, d, "atoms"), "atom_fqdn", "fqdn", [lambda c: c, low, lambda c: F.regexp_replace(low(c), _LEAF, "")])


@query("""WITH h AS (SELECT hp_id, kind, try_cast(min_value AS DOUBLE) AS lo, try_cast(max_value AS DOUBLE) AS hi, try_cast(default_value AS DOUBLE) AS v, atom_id FROM hyperparams)
SELECT * FROM (SELECT 'bounds_ordered' AS rule, count(*) AS n FROM h WHERE NOT lo <= hi UNION ALL SELECT 'default_in_bounds', count(*) FROM h WHERE NOT (v >= lo AND v <= hi) UNION ALL SELECT 'has_atom', count(*) FROM h WHERE atom_id IS NULL UNION ALL SELECT 'known_kind', count(*) FROM h WHERE NOT kind IN ('int', 'float') UNION ALL SELECT 'duplicate', count(*) FROM (SELECT hp_id FROM h GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
def expectation_report(spark, d):
    num = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    lo, hi, v = num("min_value"), num("max_value"), num("default_value")
    rules = {"bounds_ordered": lo <= hi, "default_in_bounds": (v >= lo) & (v <= hi), "has_atom": F.col("atom_id").isNotNull(), "known_kind": F.col("kind").isin("int", "float")}
    return catalog.expectations(table(spark, d, "hyperparams"), "hp_id", rules)


@query("SELECT run_id, last_update_at, CAST(CASE WHEN NOT coalesce(json_valid(stages), FALSE) THEN 0 WHEN json_type(stages) = 'OBJECT' THEN len(json_keys(stages)) WHEN json_type(stages) = 'ARRAY' THEN json_array_length(stages) ELSE 0 END AS BIGINT) AS n, CASE WHEN NOT coalesce(json_valid(stages), FALSE) THEN FALSE WHEN json_type(stages) = 'OBJECT' THEN list_contains(json_keys(stages), 'refine') ELSE FALSE END AS has_refine FROM pipeline_runs")
def json_member_count(spark, d):
    return table(spark, d, "pipeline_runs").select("run_id", "last_update_at", catalog.json_members(F.col("stages")).cast("bigint").alias("n"), catalog.json_contains(F.col("stages"), "refine").alias("has_refine"))


@query("WITH v AS (SELECT DISTINCT atom_id, version_id, semver, fingerprint, created_at FROM atom_versions WHERE atom_id IS NOT NULL), t AS (SELECT *, row_number() OVER w AS step, lag(semver) OVER w AS ps, lag(fingerprint) OVER w AS pf FROM v WINDOW w AS (PARTITION BY atom_id ORDER BY created_at, version_id)) SELECT version_id, step, CASE WHEN step = 1 THEN '' ELSE concat_ws(',', CASE WHEN semver IS DISTINCT FROM ps THEN 'semver' END, CASE WHEN fingerprint IS DISTINCT FROM pf THEN 'fingerprint' END) END AS changed FROM t")
def evolution_trace(spark, d):
    v = table(spark, d, "atom_versions").where("atom_id IS NOT NULL").select("atom_id", "version_id", "semver", "fingerprint", "created_at").distinct()
    return catalog.version_trace(v, "atom_id", ["created_at", "version_id"], ["semver", "fingerprint"]).select("version_id", "step", "changed")


@query("WITH b AS (SELECT atom_fqdn, benchmark_name, metric_name, measured_at < TIMESTAMP '2025-06-01' AS old, metric_value AS v FROM benchmarks WHERE isfinite(metric_value) AND atom_fqdn IS NOT NULL), a AS (SELECT atom_fqdn, benchmark_name, metric_name, avg(v) FILTER (old) AS o, avg(v) FILTER (NOT old) AS n FROM b GROUP BY 1, 2, 3) SELECT atom_fqdn, count(*) AS n_shared, bool_and((o - n) / abs(o) >= 0.05) AS better FROM a WHERE o <> 0 AND n IS NOT NULL GROUP BY 1")
def supersession(spark, d):
    b = table(spark, d, "benchmarks").where("NOT isnan(metric_value) AND abs(metric_value) < double('infinity') AND atom_fqdn IS NOT NULL")
    on = ["benchmark_name", "metric_name"]
    mean = lambda t: b.where(t).groupBy("atom_fqdn", *on).agg(F.avg("metric_value").alias("v"))
    return catalog.supersedes(mean("measured_at < TIMESTAMP_NTZ '2025-06-01 00:00:00'"), mean("measured_at >= TIMESTAMP_NTZ '2025-06-01 00:00:00'"), "atom_fqdn", on, "v")


@query("WITH g AS (SELECT count(*) AS n, count(DISTINCT metric_name) AS d FROM benchmarks GROUP BY atom_fqdn, benchmark_name HAVING count(*) > 1) SELECT count(*) AS n_groups, round(avg(CASE WHEN d <= 1 THEN 1 ELSE 0 END), 6) AS stable_share FROM g")
def stability_share(spark, d):
    return catalog.stability(table(spark, d, "benchmarks"), ["atom_fqdn", "benchmark_name"], "metric_name").select("n_groups", R("stable_share").alias("stable_share"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def dominant_key(spark, d):
    return catalog.dominant(table(spark, d, "events"), "user_id", "event_type")


@query("WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, least(CAST(floor((value - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM events JOIN r USING (event_type) GROUP BY 1, 2")
def histogram_closed(spark, d):
    return catalog.histogram(table(spark, d, "events"), "event_type", "value", 10)


#: The data sets' tags; '' is a tag of its own.
_TAGS = {"clean": "clean", "heavy_nonlinearity": "heavy_nonlinearity", "high_noise": "high_noise", "long_window": "long_window", "missing_blocks": "missing_blocks", "mixed_rate": "mixed_rate", "noisy": "noisy", "short_window": "short_window", "": "untagged"}


@query("SELECT benchmark_name, " + ", ".join(f"round(avg(metric_value) FILTER (dataset_tag = '{t}'), 9) AS {n}" for t, n in _TAGS.items()) + f", count(*) FILTER (dataset_tag IS NULL OR dataset_tag NOT IN ({', '.join(repr(t) for t in _TAGS)})) AS n_other FROM benchmarks WHERE isfinite(metric_value) GROUP BY 1")
def variant_pivot(spark, d):
    """One column per tag; rows with any other tag are counted, so none is lost."""
    b = table(spark, d, "benchmarks").where("NOT isnan(metric_value) AND abs(metric_value) < double('infinity')")
    tag = F.col("dataset_tag")
    return b.groupBy("benchmark_name").agg(*[R(F.avg(F.when(tag == t, F.col("metric_value"))), 9).alias(n) for t, n in _TAGS.items()], F.count(F.when(tag.isNull() | ~tag.isin(list(_TAGS)), 1)).alias("n_other"))


# --- diagnostics that need pairs, graphs or matrices


@query(f"WITH RECURSIVE {_E}, u AS (SELECT parent_id AS a, node_id AS b FROM e WHERE parent_id <> node_id UNION SELECT node_id, parent_id FROM e WHERE parent_id <> node_id), t AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b), c AS (SELECT a, least(a, min(b)) AS c FROM t GROUP BY 1) SELECT greatest((SELECT count(*) FROM u WHERE a < b) - (count(*) - count(DISTINCT c)), 0) AS metric, greatest((SELECT count(*) FROM u WHERE a < b) - (count(*) - count(DISTINCT c)), 0) = 0 AS flag FROM c", "diag_belief_propagation_detect_graph_cycles")
def _graph_cycles(spark, d):
    e = _edges(spark, d).where("parent_id <> node_id")
    n = e.select(F.least("parent_id", "node_id").alias("a"), F.greatest("parent_id", "node_id").alias("b")).distinct().agg(F.count(F.lit(1)).alias("m"))
    c = components(e, "parent_id", "node_id").agg((F.count(F.lit(1)) - F.countDistinct("component")).alias("k"))
    x = F.greatest(F.col("m") - F.col("k"), F.lit(0))
    return n.crossJoin(c).select(x.alias("metric"), (x == 0).alias("flag"))  # one row each


@query(f"WITH RECURSIVE {_E}, u AS (SELECT parent_id AS a, node_id AS b FROM e UNION SELECT node_id, parent_id FROM e), t AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b), c AS (SELECT a, least(a, min(b)) AS c FROM t GROUP BY 1) SELECT count(DISTINCT c) AS metric, count(DISTINCT c) = 1 AS flag FROM c", "diag_graph_signal_processing_validate_graph_connectivity")
def _connectivity(spark, d):
    x = components(_edges(spark, d).where("parent_id <> node_id"), "parent_id", "node_id").agg(F.countDistinct("component").alias("metric"))
    return x.select("metric", (F.col("metric") == 1).alias("flag"))


def _matrix(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.sum("l_quantity").alias("v"))


_MATRIX = "m AS (SELECT l_suppkey % 20 AS r, l_partkey % 20 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_MATRIX} SELECT round(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))), 6) AS metric, max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) < 1e-10 AS flag FROM m a FULL JOIN m b ON a.r = b.c AND a.c = b.r", "diag_graph_signal_processing_check_laplacian_symmetry")
def _symmetry(spark, d):
    # each entry is added at its own place and subtracted at the mirrored one, so one grouping does it
    m = _matrix(spark, d)
    both = m.unionByName(m.select(F.col("c").alias("r"), F.col("r").alias("c"), (-F.col("v")).alias("v")))
    x = both.groupBy("r", "c").agg(F.abs(F.sum("v")).alias("v")).agg(F.max("v").alias("m"))
    return x.select(R("m").alias("metric"), (F.col("m") < 1e-10).alias("flag"))


@query("WITH p AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM p GROUP BY 1, 2), x AS (SELECT a.label, b.label AS o, abs(sum(a.v * b.v)) AS s FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2) SELECT round(max(s), 6) AS metric, max(s) <= 1e-6 AS flag FROM x", "diag_dimensionality_reduction_validate_orthogonality")
def _orthogonality(spark, d):
    c = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    o = c.select(F.col("label").alias("o"), "i", F.col("v").alias("w"))
    x = c.join(o, "i").where("label < o").groupBy("label", "o").agg(F.abs(F.sum(F.col("v") * F.col("w"))).alias("s")).agg(F.max("s").alias("m"))
    return x.select(R("m").alias("metric"), (F.col("m") <= 1e-6).alias("flag"))


_PTS = "p AS (SELECT n_nationkey AS k, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey * n_regionkey AS DOUBLE) AS y FROM nation)"


def _points(spark, d, i: int) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias(f"k{i}"), F.col("n_nationkey").cast("double").alias(f"x{i}"), (F.col("n_regionkey") * F.col("n_regionkey")).cast("double").alias(f"y{i}"))


def _pairs(spark, d) -> DataFrame:
    return _points(spark, d, 1).join(F.broadcast(_points(spark, d, 2))).where("k1 < k2")  # the nations are a fixed few


@query(f"WITH {_PTS} SELECT count(*) FILTER (abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) < 1e-10) AS metric, count(*) FILTER (abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) < 1e-10) > 0 AS flag FROM p a JOIN p b ON a.k < b.k JOIN p c ON b.k < c.k", "diag_geometry_detect_collinear_points")
def _collinear(spark, d):
    t = _pairs(spark, d).join(F.broadcast(_points(spark, d, 3))).where("k2 < k3")
    x = t.agg(F.count(F.when(F.expr("abs((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) < 1e-10"), 1)).alias("metric"))
    return x.select("metric", (F.col("metric") > 0).alias("flag"))


@query(f"WITH {_PTS}, q AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s FROM p a JOIN p b ON a.k < b.k) SELECT round((SELECT max(greatest(abs(x), abs(y))) FROM p) / min(s) FILTER (s > 0), 6) AS metric, (SELECT max(greatest(abs(x), abs(y))) FROM p) / min(s) FILTER (s > 0) > 1e10 AS flag FROM q", "diag_geometry_analyze_numeric_precision")
def _precision(spark, d):
    s = F.expr("sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))")
    near = _pairs(spark, d).select(s.alias("s")).where("s > 0").agg(F.min("s").alias("s"))
    top = _points(spark, d, 1).agg(F.max(F.greatest(F.abs("x1"), F.abs("y1"))).alias("t"))
    return near.crossJoin(top).select(R(F.col("t") / F.col("s")).alias("metric"), (F.col("t") / F.col("s") > 1e10).alias("flag"))  # one row each


@query(f"WITH {_PTS}, q AS (SELECT avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s FROM p a JOIN p b ON a.k < b.k) SELECT round(s, 6) AS metric, s > 0.01 * (SELECT greatest(max(x) - min(x), max(y) - min(y)) FROM p) AS flag FROM q", "diag_particle_filter_analyze_particle_diversity")
def _diversity(spark, d):
    s = _pairs(spark, d).agg(F.avg(F.expr("sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))")).alias("s"))
    top = _points(spark, d, 1).agg(F.greatest(F.max("x1") - F.min("x1"), F.max("y1") - F.min("y1")).alias("t"))
    return s.crossJoin(top).select(R("s").alias("metric"), (F.col("s") > 0.01 * F.col("t")).alias("flag"))  # one row each


@query("SELECT count(*) FILTER (NOT (a + b <= 25 AND a >= 2)) AS metric, count(*) FILTER (NOT (a + b <= 25 AND a >= 2)) > 0 AS flag FROM (SELECT unnest(range(20)) AS a), (SELECT unnest(range(30)) AS b)", "diag_dynamic_programming_prune_infeasible_states")
def _infeasible(spark, d):
    t = spark.range(20 * 30).selectExpr("id div 30 AS a", "id % 30 AS b")  # the states by their number, without a join
    x = t.agg(F.count(F.when(F.expr("NOT (a + b <= 25 AND a >= 2)"), 1)).alias("metric"))
    return x.select("metric", (F.col("metric") > 0).alias("flag"))


@query("WITH s AS (SELECT s_nationkey AS k, list_distinct(list(s_suppkey % 40)) AS v FROM supplier GROUP BY 1), p AS (SELECT len(list_filter(a.v, lambda x: NOT list_contains(b.v, x))) > 0 AS ok FROM s a JOIN s b ON len(a.v) > len(b.v)) SELECT round(coalesce(avg(CASE WHEN ok THEN 1 ELSE 0 END), 1), 6) AS metric, coalesce(avg(CASE WHEN ok THEN 1 ELSE 0 END), 1) > 0.95 AS flag FROM p", "diag_greedy_validate_matroid_exchange")
def _exchange(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set(F.col("s_suppkey") % 40).alias("v"))
    b = s.select(F.col("v").alias("w"))
    x = s.join(F.broadcast(b), F.size("v") > F.size("w")).agg(F.coalesce(F.avg((F.size(F.array_except("v", "w")) > 0).cast("int")), F.lit(1.0)).alias("m"))  # one set per nation, of at most 40
    return x.select(R("m").alias("metric"), (F.col("m") > 0.95).alias("flag"))


@query("WITH p AS (SELECT i AS p FROM (SELECT unnest(range(2, 542)) AS i) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 24)) AS j) WHERE j < i AND i % j = 0)) SELECT p_partkey, CASE WHEN p_partkey < 2 THEN p_partkey ELSE coalesce(CAST(min(p) AS BIGINT), 0) END AS divisor FROM part LEFT JOIN p ON p < p_partkey AND p_partkey % p = 0 GROUP BY 1", "diag_number_theory_check_small_prime_divisors")
def _primes(spark, d):
    return table(spark, d, "part").select("p_partkey", catalog.smallest_prime(F.col("p_partkey")).cast("bigint").alias("divisor"))


@query("SELECT o_orderkey, o_orderkey * 100000 > 2147483647 // (o_custkey + 1) AS overflows, CAST(ceil(log2(o_orderkey * 100000 + 1)) AS BIGINT) AS bits FROM orders WHERE o_orderkey > 0", "diag_number_theory_detect_modular_overflow")
def _modular(spark, d):
    b = F.col("o_orderkey") * 100000
    return table(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", F.expr("o_orderkey * 100000 > 2147483647 div (o_custkey + 1)").alias("overflows"), F.ceil(F.log2(b + 1)).cast("bigint").alias("bits"))


@query("SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) + (9223372036854775807 - o_custkey) > 9223372036854775807 AS overflows, CAST((CAST(o_orderkey AS HUGEINT) + (9223372036854775807 - o_custkey)) // 2 AS BIGINT) AS mid FROM orders", "diag_searching_detect_midpoint_overflow")
def _midpoint(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.expr("9223372036854775807 - o_custkey").alias("hi"))
    overflows, mid = catalog.midpoint(F.col("o_orderkey"), F.col("hi"))
    return t.select("o_orderkey", overflows.alias("overflows"), mid.alias("mid"))


@query("SELECT lang, count(DISTINCT c) AS symbols, count(DISTINCT c) FILTER (c IN ('a', 'b', '波')) AS shared FROM (SELECT lang, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY 1", "diag_string_matching_analyze_alphabet_size")
def _alphabet(spark, d):
    return catalog.alphabet(table(spark, d, "documents"), "lang", "text", ["a", "b", "波"])


@query("SELECT doc_id, round(40.0 / n_chars, 6) AS ratio, CASE WHEN 40 > n_chars THEN 'longer' WHEN 40.0 / n_chars > 0.5 THEN 'long' ELSE 'short' END AS kind FROM documents WHERE n_chars > 0", "diag_string_matching_check_pattern_text_ratio")
def _ratio(spark, d):
    r = F.lit(40).cast("double") / F.col("n_chars")
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", R(r).alias("ratio"), F.when(r > 1, "longer").when(r > 0.5, "long").otherwise("short").alias("kind"))


@query(f"SELECT g, pos, round(x * (y / 500), 9) AS product, round((1 + x / 500) * (1 + y / 10) - 1, 9) AS plus_one FROM ({_DIAG})")
def combine_product(spark, d):
    parts = F.array(F.col("x"), F.col("y") / 500)
    p = F.aggregate(parts, F.lit(1.0), lambda s, v: s * v)
    q = F.aggregate(F.array(F.col("x") / 500, F.col("y") / 10), F.lit(1.0), lambda s, v: s * (1 + v)) - 1
    return _diag_base(spark, d).select("g", "pos", R(p, 9).alias("product"), R(q, 9).alias("plus_one"))


@query(f"SELECT g, pos FROM ({_DIAG}) WHERE pos % 3 = 2 AND pos >= 2", "slice_text")
def _slice(spark, d):
    from tessera.sources.files import array_slice

    return array_slice(_diag_base(spark, d).select("g", "pos"), "g", "pos", "2::3")


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1", "array_summary")
def _summary(spark, d):
    from tessera.sources.files import array_summary

    return array_summary(table(spark, d, "events"), "event_type", "value").select("event_type", "n", "min", "max", R("mean").alias("mean"), R("std").alias("std"))


# --- kernels without an SQL form


@query()
def bandpass_peaks_rate(spark, d):
    return signals.event_rate_from_signal(_diag_base(spark, d).select("g", "pos", "x"), "g", "pos", "x", 60.0)


@query()
def wavelet_scale(spark, d):
    return signals.wavelet_scale(_diag_base(spark, d).select("g", "pos", "x"), "g", "pos", "x")


@query(f"WITH l AS (SELECT g, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys, count(*) AS n FROM ({_DIAG}) GROUP BY 1), c AS (SELECT g, n, list_transform(range(n), lambda p: list_sum(list_transform(list_filter(range(n), lambda i: p + (n - 1) // 2 - i BETWEEN 0 AND n - 1), lambda i: xs[i + 1] * ys[p + (n - 1) // 2 - i + 1]))) AS v FROM l) SELECT g, unnest(range(n)) AS pos, round(unnest(list_transform(v, lambda e: e / list_max(list_transform(v, lambda a: abs(a))))), 6) AS combined FROM c")
def combine_convolve(spark, d):
    return signals.combine_convolve(_diag_base(spark, d).select("g", "pos", "x", "y"), "g", "pos", ["x", "y"]).withColumn("combined", R("combined"))


@query()
def combine_coherence(spark, d):
    return signals.combine_coherence(_diag_base(spark, d).select("g", "pos", "x", "y"), "g", "pos", ["x", "y"])


@query()
def fit_segments(spark, d):
    return signals.fit_segments(_diag_base(spark, d).select("g", "pos", "x"), "g", "pos", "x")


@query(f"""WITH RECURSIVE a AS (SELECT g, pos + 1 AS m, y / 11 AS a FROM ({_DIAG})),
 s AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS m, CAST(0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS bar FROM a
       UNION ALL SELECT g, m, h, pow(CAST(m AS DOUBLE), -0.75) * (ln(10.0) - sqrt(m) / 0.05 * h) + (1 - pow(CAST(m AS DOUBLE), -0.75)) * bar FROM (SELECT a.g, a.m, s.h + (0.65 - a.a - s.h) / (a.m + 10) AS h, s.bar FROM s JOIN a ON a.g = s.g AND a.m = s.m + 1))
SELECT g, round(exp(arg_max(bar, m)), 6) AS step FROM s GROUP BY 1""", "diag_mcmc_compute_dual_averaging_step_size")
def _steps(spark, d):
    return signals.step_sizes(_diag_base(spark, d).select("g", "pos", (F.col("y") / 11).alias("a")), "g", "pos", "a").withColumn("step", R("step"))


@query(name="diag_mcmc_compute_convergence_diagnostics")
def _chains(spark, d):
    e = _diag_base(spark, d).select("k", F.col("g").alias("chain"), "pos", "x")
    return signals.chain_diagnostics(e.withColumn("chain", F.col("chain") % 4), "k", "chain", "pos", "x")


@query(name="diag_linear_algebra_matrix_checks")
def _matrices(spark, d):
    m = _matrix(spark, d).withColumn("k", F.lit(1)).select("k", "r", "c", "v")
    return signals.matrix_checks(m, "k", "r", "c", "v")  # 20 x 20 whatever the data


@query()
def ransac_line(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return fitting.ransac_line(p, "p_brand", "p_size", "p_retailprice")


# --- streams, run over what their source holds


def _stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    """The windows of a stream in update mode: a batch writes only those it changed; the last one written of each counts."""
    at = _scratch(spark)
    q = logs.window_counts(_stream(spark, d), "ts", "event_type", "value", late="3650 days")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/windows/epoch={epoch}")

    s = q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    s.awaitTermination()
    last = spark.read.parquet(f"{at}/windows").groupBy("w", "event_type").agg(F.max(F.struct("epoch", "n", "total")).alias("l"))
    return last.select(F.col("w").cast("timestamp_ntz").alias("w"), "event_type", "l.n", R("l.total").alias("total"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def stream_event_log_upsert(spark, d):
    at = _scratch(spark)
    best = _stream(spark, d).select("user_id", "ts", "event_type")
    s = best.writeStream.foreachBatch(logs.upsert_sink(f"{at}/table", "user_id", "ts")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    s.awaitTermination()
    return logs.latest_state(spark, f"{at}/table", "user_id", "ts").select("user_id", "ts", "event_type")


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events), y AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM y GROUP BY user_id, s")
def session_windows(spark, d):
    s = logs.session_counts(table(spark, d, "events"), "ts", "user_id", "2 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("WITH e AS (SELECT event_id // 2 AS dsp, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS kind, epoch_us(ts) / 1e6 AS t, event_type AS g, event_type <> 'error' AS ok FROM events), s AS (SELECT dsp, t, g FROM e WHERE kind = 'start'), f AS (SELECT dsp, t, ok FROM e WHERE kind = 'finish') SELECT g, count(*) AS started, count(f.t) AS finished, count(*) FILTER (NOT ok) AS failed, round(avg(f.t - s.t), 4) AS mean_s, round(max(f.t - s.t), 4) AS max_s FROM s LEFT JOIN f USING (dsp) GROUP BY 1")
def start_finish_latency(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 2").alias("dsp"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("finish").alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("g"), (F.col("event_type") != "error").alias("ok"))
    out = logs.dispatch_latency(e, "dsp", "kind", "t", "g", "ok")
    return out.select("g", "started", "finished", "failed", R("mean_s", 4).alias("mean_s"), R("max_s", 4).alias("max_s"))



