"""Queries of matching, telemetry, source, series and ledger operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import units
from tessera.functions.text import norm_id, norm_name
from tessera.operators import matching, telemetry
from tessera.plans.reference_queries import _DIAG, _E, _ID, _NAME, R, _diag_base, _edges
from tessera.session import Written, shared_dir
from tessera.sources import files
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


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/tessera-files-{uuid.uuid4().hex}"


# --- sources and sinks


@query("SELECT event_id, user_id, event_type, value FROM events")
def event_log_jsonl(spark, d):
    """The event log written as JSON lines and read again."""
    at = _scratch(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    e.write.json(at)
    return files.read(spark, at, "json", e.schema)


@query("SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def vector_index_round_trip(spark, d):
    """An index saved with its declarations and loaded again."""
    at = _scratch(spark)
    table(spark, d, "embeddings").select("vec_id", "label", "embedding").write.parquet(at)
    return spark.read.parquet(at).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def cached_node_output(spark, d):
    """Outputs kept by node; reading one node's opens its folder only."""
    at = _scratch(spark)
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("node")).write.partitionBy("node").parquet(at)
    return spark.read.parquet(at).where("node = 'R'").drop("node")


@query(f"WITH {_E} SELECT CAST(dense_rank() OVER (ORDER BY parent_id) - 1 AS BIGINT) AS source, CAST(len(node_id) AS BIGINT) - 1 AS target, CAST(len(parent_id) AS DOUBLE) AS weight FROM e")
def dimacs_round_trip(spark, d):
    """Arcs written as the lines of a graph file, with a header, and read again."""
    at = _scratch(spark)
    e = _edges(spark, d)
    number = e.select("parent_id").distinct().select("parent_id", F.row_number().over(Window.orderBy("parent_id")).alias("n"))
    e.join(number, "parent_id").select(F.concat_ws(" ", F.lit("a"), "n", F.length("node_id"), F.length("parent_id")).alias("value")).unionByName(spark.createDataFrame([("c arcs",), ("p sp 0 0",)], "value string")).write.text(at)
    return files.read_dimacs(spark, at)


@query("SELECT tier, count(*) AS n FROM (SELECT 'general' AS tier FROM atoms WHERE visibility_tier = 'general' UNION ALL SELECT 'internal' FROM atoms WHERE visibility_tier IN ('general', 'internal')) GROUP BY 1")
def tier_snapshots(spark, d):
    """One snapshot for each cumulative tier."""
    at = _scratch(spark)
    files.write_tiers(table(spark, d, "atoms").select("atom_id", "visibility_tier"), "visibility_tier", ["general", "internal"], at)
    parts = [spark.read.parquet(f"{at}/{t}.parquet").select(F.lit(t).alias("tier")) for t in ("general", "internal")]
    return parts[0].unionByName(parts[1]).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv_with_schema(spark, d):
    """A table as CSV, read with a declared schema."""
    at = _scratch(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    o.write.option("header", "true").csv(at)
    return files.read(spark, at, "csv", o.schema).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT atom_id, sha256(string_agg(name || '=' || coalesce(default_value, ''), chr(10) ORDER BY name || '=' || coalesce(default_value, ''))) AS hash, count(*) AS n FROM (SELECT DISTINCT lower(trim(hp_id)) AS hp_id, " + _ID("atom_id") + " AS atom_id, coalesce(name, '') AS name, default_value FROM hyperparams) WHERE atom_id <> '' GROUP BY 1")
def hyperparams_manifest(spark, d):
    """One hash of an atom's parameters, whatever the order they are given in."""
    h = table(spark, d, "hyperparams").select(F.lower(F.trim("hp_id")).alias("hp_id"), norm_id(F.col("atom_id")).alias("atom_id"), F.coalesce("name", F.lit("")).alias("name"), "default_value").distinct().where("atom_id IS NOT NULL")
    line = F.concat("name", F.lit("="), F.coalesce("default_value", F.lit("")))
    return h.groupBy("atom_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT fqdn, count(*) AS n, list_sort(list(DISTINCT metric_name)) AS metrics FROM (SELECT {_NAME('atom_fqdn')} AS fqdn, metric_name FROM benchmarks) WHERE fqdn <> '' GROUP BY 1")
def benchmarks_by_atom(spark, d):
    """Each atom's benchmarks; the metrics are made distinct before the shuffle, so a hot atom is no large group."""
    b = table(spark, d, "benchmarks").select(norm_name(F.col("atom_fqdn")).alias("fqdn"), "metric_name").where("fqdn IS NOT NULL")
    return b.groupBy("fqdn").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("metric_name")).alias("metrics"))


@query("WITH x AS (SELECT run_id, unnest(json_keys(metadata)) AS k FROM (SELECT DISTINCT run_id, metadata FROM pipeline_runs WHERE json_valid(metadata) AND json_type(metadata) = 'OBJECT')) SELECT k, count(DISTINCT run_id) AS n_runs FROM x GROUP BY 1")
def metadata_keys(spark, d):
    """The top-level keys of JSON objects and in how many runs they stand."""
    t = table(spark, d, "pipeline_runs").select("run_id", "metadata").distinct()
    keyed = t.where(F.expr("schema_of_variant(try_parse_json(metadata)) LIKE 'OBJECT%'")).select("run_id", F.explode(F.json_object_keys("metadata")).alias("k"))
    return keyed.groupBy("k").agg(F.countDistinct("run_id").alias("n_runs"))


# --- catalog views


@query(f"SELECT DISTINCT {_ID('atom_id')} AS atom_id, fqdn, status, description FROM atoms WHERE is_publishable AND visibility_tier = 'general' AND status = 'approved'")
def catalog_public(spark, d):
    return table(spark, d, "atoms").where("is_publishable AND visibility_tier = 'general' AND status = 'approved'").select(norm_id(F.col("atom_id")).alias("atom_id"), "fqdn", "status", "description").distinct()


@query("SELECT DISTINCT namespace_root || '.' || namespace_path AS path, source_repo_id FROM atoms WHERE trim(namespace_root) <> '' AND trim(namespace_path) <> '' AND source_repo_id IS NOT NULL")
def catalog_installations(spark, d):
    return table(spark, d, "atoms").where("trim(namespace_root) <> '' AND trim(namespace_path) <> '' AND source_repo_id IS NOT NULL").select(F.concat_ws(".", "namespace_root", "namespace_path").alias("path"), "source_repo_id").distinct()


@query("SELECT benchmark_id, benchmark_name, metric_name FROM (SELECT * FROM benchmarks WHERE atom_fqdn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY atom_fqdn, benchmark_name ORDER BY measured_at DESC NULLS LAST, benchmark_id DESC, metric_name DESC) = 1)")
def audit_latest(spark, d):
    """The latest record of each subject and type."""
    b = table(spark, d, "benchmarks").where("atom_fqdn IS NOT NULL")
    return telemetry.latest(b, ["atom_fqdn", "benchmark_name"], ["measured_at", "benchmark_id"], ["metric_name"]).join(b.select("atom_fqdn", "benchmark_name").distinct(), ["atom_fqdn", "benchmark_name"]).join(
        telemetry.latest(b, ["atom_fqdn", "benchmark_name"], ["measured_at"], ["benchmark_id"]), ["atom_fqdn", "benchmark_name"]).select("benchmark_id", "benchmark_name", "metric_name")


@query(f"WITH a AS (SELECT DISTINCT owner_id, {_ID('atom_id')} AS atom_id FROM atoms), v AS (SELECT {_ID('atom_id')} AS atom_id, count(DISTINCT version_id) AS n FROM atom_versions GROUP BY 1), h AS (SELECT {_ID('atom_id')} AS atom_id, count(DISTINCT hp_id) AS n FROM hyperparams GROUP BY 1) SELECT owner_id, count(*) AS n_atoms, CAST(sum(coalesce(v.n, 0)) AS BIGINT) AS n_versions, CAST(sum(coalesce(h.n, 0)) AS BIGINT) AS n_params FROM a LEFT JOIN v USING (atom_id) LEFT JOIN h USING (atom_id) WHERE atom_id <> '' AND owner_id IS NOT NULL GROUP BY 1")
def originator_impact(spark, d):
    """Sums per owner; each child table is reduced to one row an atom first, so that none multiplies another."""
    a = table(spark, d, "atoms").select("owner_id", norm_id(F.col("atom_id")).alias("atom_id")).distinct().where("atom_id IS NOT NULL AND owner_id IS NOT NULL")
    per = lambda n, k, c: table(spark, d, n).groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.countDistinct(k).alias(c))
    j = a.join(per("atom_versions", "version_id", "v"), "atom_id", "left").join(per("hyperparams", "hp_id", "h"), "atom_id", "left")
    return j.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.sum(F.coalesce("v", F.lit(0))).alias("n_versions"), F.sum(F.coalesce("h", F.lit(0))).alias("n_params"))


@query("SELECT status, coalesce(visibility_tier, 'none') AS tier, count(*) AS n, count(*) FILTER (is_publishable) AS n_publishable, CAST(grouping(status) * 2 + grouping(coalesce(visibility_tier, 'none')) AS BIGINT) AS level FROM atoms GROUP BY GROUPING SETS ((), (status), (coalesce(visibility_tier, 'none')), (status, coalesce(visibility_tier, 'none')))")
def coverage_summary(spark, d):
    """The same counters under several groupings in one pass."""
    a = table(spark, d, "atoms").withColumn("tier", F.coalesce("visibility_tier", F.lit("none")))
    return a.cube("status", "tier").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_publishable"), 1)).alias("n_publishable"), F.grouping_id().cast("bigint").alias("level"))


@query(f"WITH k AS (SELECT DISTINCT {_NAME('atom_fqdn')} AS fqdn FROM benchmarks), a AS (SELECT {_NAME('fqdn')} AS fqdn, min({_ID('atom_id')}) AS atom_id, count(DISTINCT {_ID('atom_id')}) AS n FROM atoms GROUP BY 1) SELECT k.fqdn, CASE WHEN n = 1 THEN atom_id END AS atom_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM k LEFT JOIN a USING (fqdn) WHERE k.fqdn <> ''")
def artifact_bindings(spark, d):
    """Keys resolved to artifacts, with a diagnostic where none or several fit."""
    k = table(spark, d, "benchmarks").select(norm_name(F.col("atom_fqdn")).alias("fqdn")).where("fqdn IS NOT NULL").distinct()
    a = table(spark, d, "atoms").groupBy(norm_name(F.col("fqdn")).alias("fqdn")).agg(F.min(norm_id(F.col("atom_id"))).alias("a"), F.countDistinct(norm_id(F.col("atom_id"))).alias("n"))
    return k.join(a, "fqdn", "left").select("fqdn", F.when(F.col("n") == 1, F.col("a")).alias("atom_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("outcome"))


@query("SELECT status, count(*) AS n, count(*) FILTER (is_optional) AS n_optional, count(DISTINCT concept_type) AS n_concepts FROM (SELECT DISTINCT node_id, status, is_optional, concept_type FROM cdg_nodes) GROUP BY 1")
def review_summary(spark, d):
    n = table(spark, d, "cdg_nodes").select("node_id", "status", "is_optional", "concept_type").distinct()
    return n.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_optional"), 1)).alias("n_optional"), F.countDistinct("concept_type").alias("n_concepts"))


@query(f"""WITH a AS (SELECT {_ID('atom_id')} AS atom_id, max(fqdn) AS fqdn FROM atoms GROUP BY 1), p AS (SELECT DISTINCT {_ID('atom_id')} AS atom_id, port_name, direction, ordinal FROM io_specs WHERE port_name IS NOT NULL)
SELECT atom_id, fqdn, list_sort(list(direction || ':' || port_name)) AS assets, count(*) AS n FROM a JOIN p USING (atom_id) WHERE atom_id <> '' GROUP BY 1, 2""")
def data_artifacts(spark, d):
    """Each atom with its ports as one nested list."""
    a = table(spark, d, "atoms").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.max("fqdn").alias("fqdn"))
    p = table(spark, d, "io_specs").select(norm_id(F.col("atom_id")).alias("atom_id"), "port_name", "direction", "ordinal").where("port_name IS NOT NULL").distinct()
    return a.join(p, "atom_id").groupBy("atom_id", "fqdn").agg(F.sort_array(F.collect_list(F.concat("direction", F.lit(":"), "port_name"))).alias("assets"), F.count("port_name").alias("n")).where("size(assets) > 0")


# --- scalar functions


@query("SELECT o_orderkey, (a < b + 1e-9) AS le, (a > b - 1e-9) AS ge FROM (SELECT o_orderkey, o_totalprice / 3 AS a, (o_totalprice + (o_orderkey % 3 - 1)) / 3 AS b FROM orders)")
def fuzzy_comparisons(spark, d):
    a, b = F.col("o_totalprice") / 3, (F.col("o_totalprice") + (F.col("o_orderkey") % 3 - 1)) / 3
    return table(spark, d, "orders").select("o_orderkey", matching.le_fuzzy(a, b).alias("le"), matching.ge_fuzzy(a, b).alias("ge"))


@query("SELECT DISTINCT fqdn, '@software{' || replace(fqdn, '.', '_') || ',' || chr(10) || '  author = {' || owner_id || '},' || chr(10) || '  title = {' || fqdn || '},' || chr(10) || '  year = {' || year(created_at) || '}' || chr(10) || '}' AS bibtex FROM atoms WHERE fqdn IS NOT NULL AND owner_id IS NOT NULL AND created_at IS NOT NULL")
def bibtex(spark, d):
    entry = F.concat(F.lit("@software{"), F.regexp_replace("fqdn", r"\.", "_"), F.lit(",\n  author = {"), "owner_id", F.lit("},\n  title = {"), "fqdn", F.lit("},\n  year = {"), F.year("created_at").cast("string"), F.lit("}\n}"))
    return table(spark, d, "atoms").where("fqdn IS NOT NULL AND owner_id IS NOT NULL AND created_at IS NOT NULL").select("fqdn", entry.alias("bibtex")).distinct()


_UNIT_CASES = [("m", "L1"), ("  Metres ", "L1"), ("kg", "M1"), ("Hz", "T-1"), ("newton", "M1L1T-2"), ("m/s^2", "L1T-2"), ("normalized_power", "M1L2T-3"), ("mean-voltage", "M1L2T-3I-1"), ("ratio", ""), ("furlong", None), ("", None), ("peak farads", "M-1L-2T4I2"), ("ohm", "M1L2T-3I-2"), ("h", "M1L2T-2I-2"), ("T", "M1T-2I-1"), ("wb", "M1L2T-2I-1")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({u!r}, {'NULL' if c is None else repr(c)})" for u, c in _UNIT_CASES) + ") t(unit, signature)")
def unit_names(spark, d):
    """Signatures of named units; null for an unknown name, empty for a dimensionless one."""
    return spark.createDataFrame([(u,) for u, _ in _UNIT_CASES], "unit string").select("unit", units.to_compact(units.parse_units(F.col("unit"))).alias("signature"))


@query("SELECT s_suppkey, 'M' || (s_suppkey % 3 + 1) || 'L3' AS product, CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE 'M' || (s_suppkey % 3 - 1) END || 'L1' AS quotient, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'M' || (s_suppkey % 3 * 2) END || 'L4' AS square, s_suppkey % 3 = 1 AS same FROM supplier")
def unit_algebra(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", units.from_compact(F.concat(F.lit("M"), (F.col("s_suppkey") % 3).cast("string"), F.lit("L2"))).alias("a"), units.from_compact(F.lit("M1L1")).alias("b"), units.from_compact(F.lit("M1L2")).alias("c"))
    return t.select("s_suppkey", units.to_compact(units.multiply(F.col("a"), F.col("b"))).alias("product"), units.to_compact(units.divide(F.col("a"), F.col("b"))).alias("quotient"), units.to_compact(units.power(F.col("a"), 2)).alias("square"), units.compatible(F.col("a"), F.col("c")).alias("same"))


@query("SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(quarter(l_shipdate) AS BIGINT) AS q, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, strftime(l_shipdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT) AS days FROM lineitem")
def date_functions(spark, d):
    s = F.col("l_shipdate").cast("date")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.year(s).cast("bigint").alias("y"), F.quarter(s).cast("bigint").alias("q"), F.date_format(F.trunc(s, "month"), "yyyy-MM-dd").alias("month"), F.date_format(F.add_months(s, 1), "yyyy-MM-dd").alias("later"), F.date_diff(s, F.lit("1992-01-01").cast("date")).cast("bigint").alias("days")
    )


@query("SELECT event_type, abs(count(DISTINCT user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close_count, TRUE AS close_median FROM events GROUP BY 1")
def approximate_aggregates(spark, d):
    """Sketches held against exact aggregates: within a tenth."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", 0.5).alias("x"))
    return e.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close_count"), (F.abs(F.col("m") - F.col("x")) <= 0.1 * F.col("x")).alias("close_median"))


@query("SELECT c_custkey, list_sort(list_filter(['acctbal', 'name', 'phone', 'segment'], lambda k: NOT list_contains(CASE WHEN c_acctbal > 0 THEN ['name', 'acctbal', 'segment'] ELSE ['name', 'phone'] END, k))) AS missing FROM customer")
def required_keys(spark, d):
    """Rows that lack required keys."""
    have = F.when(F.col("c_acctbal") > 0, F.array(*map(F.lit, ("name", "acctbal", "segment")))).otherwise(F.array(F.lit("name"), F.lit("phone")))
    return telemetry.missing_keys(table(spark, d, "customer"), have, ["acctbal", "name", "phone", "segment"]).select("c_custkey", "missing")


# --- series


_T = "epoch(ts)"


@query(f"SELECT event_id, round({_T} * 2.0 + 5, 6) AS after, round(({_T} - max({_T}) OVER (PARTITION BY user_id)) * 2.0 + 5, 6) AS before FROM events")
def shift_time(spark, d):
    """A time axis scaled and shifted from its start, or from its end."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    last = F.max(t).over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("event_id", F.round(t * 2 + 5, 6).alias("after"), F.round((t - last) * 2 + 5, 6).alias("before"))


@query(f"SELECT event_id, round({_T} + coalesce(c_nationkey, 0), 6) AS t FROM events LEFT JOIN customer ON c_custkey = user_id")
def shift_time_by_attribute(spark, d):
    """A time axis shifted by an attribute of its record."""
    e = table(spark, d, "events").join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id", "left")
    return e.select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.coalesce("c_nationkey", F.lit(0)), 6).alias("t"))


@query(f"""WITH e AS (SELECT user_id, {_T} AS t, event_id, CASE WHEN {_T} - lag({_T}) OVER w > 86400 THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM e)
SELECT user_id, CAST(seg AS BIGINT) AS seg, count(*) AS n, round((max(t) - min(t)) / (count(*) - 1), 4) AS slope FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def time_correction(spark, d):
    """Stretches between gaps of more than a day, of at least three events; their slope from the first and last stamps."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").select("user_id", t.alias("t"), "event_id").withColumn("gap", F.coalesce((F.col("t") - F.lag("t").over(w) > 86400).cast("bigint"), F.lit(0)))
    s = e.withColumn("seg", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "seg").agg(F.count(F.lit(1)).alias("n"), F.round((F.max("t") - F.min("t")) / (F.count(F.lit(1)) - 1), 4).alias("slope")).where("n >= 3")


@query(f"WITH e AS (SELECT user_id, {_T} - lag({_T}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM events), s AS (SELECT user_id, list_sort(list(dt)) AS l FROM e WHERE dt > 0 GROUP BY 1) SELECT user_id, round(1 / l[len(l) // 2 + 1], 9) AS rate FROM s")
def sampling_rate(spark, d):
    """One over the upper median of the steps in time."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("dt", t - F.lag(t).over(w)).where("dt > 0")
    # the upper median by rank, so that no list of a group's steps is held
    r = Window.partitionBy("user_id").orderBy("dt")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return e.withColumn("r", F.row_number().over(r)).withColumn("n", n).where("r = n div 2 + 1").select("user_id", F.round(1 / F.col("dt"), 9).alias("rate"))


@query(f"SELECT user_id, round(max({_T}) - min({_T}), 6) AS seconds FROM events GROUP BY 1")
def duration(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.max(t) - F.min(t), 6).alias("seconds"))


@query(f"SELECT g, coalesce(min(pos) FILTER (x > 50), max(pos)) AS edge FROM ({_DIAG}) GROUP BY 1")
def time_edge(spark, d):
    """The first place beyond a mark, the last one if there is none."""
    return _diag_base(spark, d).groupBy("g").agg(F.coalesce(F.min(F.when(F.col("x") > 50, F.col("pos"))), F.max("pos")).alias("edge"))


@query(f"WITH r AS (SELECT g, pos, (x + lag(x) OVER w) / 2 AS v FROM ({_DIAG}) WINDOW w AS (PARTITION BY g ORDER BY pos)), s AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM r WHERE v IS NOT NULL) SELECT g, pos, round(sum(v) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM s WHERE n >= 5")
def rate_smoothed(spark, d):
    """Rates between neighbours, then a moving average of five with zeros beyond the ends."""
    w = Window.partitionBy("g").orderBy("pos")
    r = _diag_base(spark, d).withColumn("v", (F.col("x") + F.lag("x").over(w)) / 2).where("v IS NOT NULL")
    s = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("n >= 5")
    return s.select("g", "pos", R(F.sum("v").over(w.rowsBetween(-2, 2)) / 5).alias("smooth"))


@query(f"WITH s AS (SELECT g, pos, x, list(x) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l, first_value(x) OVER w AS f, last_value(x) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, row_number() OVER w AS r, count(*) OVER (PARTITION BY g) AS n FROM ({_DIAG}) WINDOW w AS (PARTITION BY g ORDER BY pos)) SELECT g, pos, list_sort(list_concat(l, list_transform(range(greatest(3 - r, 0)), lambda q: f), list_transform(range(greatest(r + 2 - n, 0)), lambda q: z)))[3] AS smooth FROM s WHERE n >= 5")
def rate_median_smoothed(spark, d):
    """A moving median of five; beyond the ends the end values stand."""
    w = Window.partitionBy("g").orderBy("pos")
    whole = Window.partitionBy("g")
    s = _diag_base(spark, d).select("g", "pos", F.collect_list("x").over(w.rowsBetween(-2, 2)).alias("l"), F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(whole).alias("n"), F.min_by("x", "pos").over(whole).alias("f"), F.max_by("x", "pos").over(whole).alias("z")).where("n >= 5")
    full = F.concat("l", F.array_repeat("f", F.greatest(3 - F.col("r"), F.lit(0))), F.array_repeat("z", F.greatest(F.col("r") + 2 - F.col("n"), F.lit(0)).cast("int")))
    return s.select("g", "pos", F.sort_array(full)[2].alias("smooth"))


@query(f"SELECT g, pos, round(x / (least(max(x) OVER (PARTITION BY g), 40.0) / (40.0 - 2.0)), 6) AS scaled, round(least(greatest(x / 25.0, 0), 1), 6) AS normal FROM ({_DIAG})")
def scale_constant(spark, d):
    """Values over the ratio of their capped peak to a span, and values over a constant, clipped."""
    top = F.least(F.max("x").over(Window.partitionBy("g")), F.lit(40.0))
    return _diag_base(spark, d).select("g", "pos", R(F.col("x") / (top / 38.0)).alias("scaled"), R(F.least(F.greatest(F.col("x") / 25.0, F.lit(0.0)), F.lit(1.0))).alias("normal"))


@query(f"WITH q AS (SELECT g, quantile_cont(x, 0.9) AS q FROM ({_DIAG}) WHERE x > 0 GROUP BY 1) SELECT g, pos, round(least(greatest(least(greatest(x / q, 0), 1) - 0.2, 0), 0.5), 6) AS v FROM ({_DIAG}) JOIN q USING (g) WHERE q > 0 AND least(greatest(x / q, 0), 1) - 0.2 > 0")
def output_clipshift(spark, d):
    """Values over a quantile of the positive ones, less a threshold, clipped; zeros are left out."""
    b = _diag_base(spark, d).select("g", "pos", "x")
    q = b.where("x > 0").groupBy("g").agg(F.percentile("x", 0.9).alias("q")).where("q > 0")
    v = F.least(F.greatest(F.least(F.greatest(F.col("x") / F.col("q"), F.lit(0.0)), F.lit(1.0)) - 0.2, F.lit(0.0)), F.lit(0.5))
    return b.join(q, "g").select("g", "pos", R(v).alias("v"), v.alias("_v")).where("_v > 0").drop("_v")


@query(f"SELECT g, pos, round(z / 4.0, 6) AS v FROM ({_DIAG}) WHERE z <> 0")
def output_nonzero(spark, d):
    return _diag_base(spark, d).where("z <> 0").select("g", "pos", R(F.col("z") / 4.0).alias("v"))


@query(f"SELECT g, pos, round((x * 0.5) * (y * 2.0), 6) AS v, round((1 + x * 0.5) * (1 + y * 2.0) - 1, 6) AS plus_one FROM ({_DIAG})")
def combine_weighted(spark, d):
    x, y = F.col("x") * 0.5, F.col("y") * 2.0
    return _diag_base(spark, d).select("g", "pos", R(x * y).alias("v"), R((1 + x) * (1 + y) - 1).alias("plus_one"))


@query(f"SELECT g, pos, round(stddev_pop(x) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS s FROM ({_DIAG})")
def trailing_deviation(spark, d):
    w = Window.partitionBy("g").orderBy("pos").rowsBetween(-4, 0)
    return _diag_base(spark, d).select("g", "pos", R(F.stddev_pop("x").over(w), 5).alias("s"))


@query(f"WITH c AS (SELECT g, i AS v, count(*) AS n FROM ({_DIAG}) GROUP BY 1, 2) SELECT g, v, n FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, v) = 1")
def mode_least(spark, d):
    """The most frequent value, the least on ties."""
    c = _diag_base(spark, d).groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("i").alias("v"))).alias("b"))
    return m.select("g", "b.v", (-F.col("b.m")).alias("n"))


@query("WITH v AS (SELECT user_id, list_distinct(list(event_id % 50)) AS l FROM events GROUP BY 1) SELECT user_id, unnest(range(50)) AS i, list_contains(l, unnest(range(50))) AS seen FROM v")
def compact_visited_set(spark, d):
    """Visited places as a dense row of booleans."""
    v = table(spark, d, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 50)).alias("l"))
    return v.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))).alias("i"), "l").select("user_id", "i", F.array_contains("l", F.col("i")).alias("seen"))


# --- search and matching

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def _tokens(c) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


@query("SELECT node_id, name, round(score, 6) AS score FROM (WITH n AS (SELECT node_id, any_value(" + _WORDS.format("name") + ") AS words, any_value(concept_type) AS category, any_value(list_distinct(list_transform(list_filter(list_transform(coalesce(inputs, []), lambda p: p.name), lambda x: x IS NOT NULL), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g')))) AS ports, any_value(len(coalesce(inputs, []))) AS n_in, any_value(len(coalesce(outputs, []))) AS n_out FROM cdg_nodes WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1 AND count(DISTINCT inputs) = 1 AND count(DISTINCT outputs) = 1), "
    "p AS (SELECT matched_primitive AS name, any_value(" + _WORDS.format("matched_primitive") + ") AS words FROM cdg_nodes WHERE matched_primitive IS NOT NULL GROUP BY 1), c AS (SELECT count(*) AS n FROM p), w AS (SELECT name, unnest(words) AS w FROM p), i AS (SELECT w, ln((SELECT n FROM c) / CAST(count(*) AS DOUBLE)) AS idf FROM w GROUP BY 1), "
    "s AS (SELECT node_id, w.name, sum(idf) AS t FROM (SELECT node_id, unnest(words) AS w FROM n) x JOIN i USING (w) JOIN w USING (w) GROUP BY 1, 2) "
    "SELECT node_id, s.name, t + CASE WHEN n.n_in BETWEEN 1 AND 2 THEN 1.5 ELSE -0.25 * abs(n.n_in - 1) END + CASE WHEN n.n_out = 1 THEN 0.75 ELSE -0.1 * abs(n.n_out - 1) END + CASE WHEN category = 'clustering' THEN 1.5 ELSE 0 END + CASE WHEN len(list_distinct(list_concat(ports, ['x', 'signal']))) > 0 THEN 2.0 * len(list_intersect(ports, ['x', 'signal'])) / len(list_distinct(list_concat(ports, ['x', 'signal']))) ELSE 0 END AS score FROM s JOIN n USING (node_id)) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score DESC, name) <= 3")  # fmt: skip
def matching_primitives(spark, d):
    """The three best primitives of each node, by words, ports, category and arity."""
    c = table(spark, d, "cdg_nodes")
    # one value but nulls: least and greatest are equal, which needs no row for each column to count
    ends = [f(x).alias(f"{x}_{t}") for x in ("name", "inputs", "outputs") for t, f in (("lo", F.min), ("hi", F.max))]
    n = c.where("name IS NOT NULL").groupBy("node_id").agg(F.any_value("concept_type", True).alias("category"), *ends).where("name_lo = name_hi AND inputs_lo = inputs_hi AND outputs_lo = outputs_hi")
    nodes = n.select("node_id", _tokens(F.col("name_lo")).alias("words"), F.transform("inputs_lo", lambda p: p["name"]).alias("ports"), "category", F.size("inputs_lo").cast("bigint").alias("n_in"), F.size("outputs_lo").cast("bigint").alias("n_out"))
    prims = c.where("matched_primitive IS NOT NULL").select(F.col("matched_primitive").alias("name")).distinct().select("name", _tokens(F.col("name")).alias("words"))
    nodes, prims = Written(nodes).df, Written(prims).df  # both are read several times
    prims = prims.select("*", F.array(F.lit("x"), F.lit("signal")).alias("ports"), F.lit("clustering").alias("category"), F.lit(1).alias("required"), F.lit(2).alias("total"), F.lit(1).alias("outs"))
    return matching.top_matches(nodes, prims, 3).select("node_id", "name", R("score").alias("score"))


@query("WITH h AS (SELECT user_id AS q, event_type AS name, max(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, max(value) * 0.9 FROM events WHERE event_id % 2 = 1 GROUP BY ALL), b AS (SELECT q, name, max(s) AS s FROM h GROUP BY ALL) SELECT q, name, round(s, 6) AS s, row_number() OVER (PARTITION BY q ORDER BY s DESC, name) AS rank FROM b QUALIFY rank <= 2")
def composite_index_merge(spark, d):
    """Hits of two indices merged into one list for each query."""
    e = table(spark, d, "events")
    part = lambda t, f: e.where(f"event_id % 2 = {t}").groupBy(F.col("user_id").alias("q"), F.col("event_type").alias("name")).agg((F.max("value") * f).alias("s"))
    return matching.merge_indices(part(0, 1.0).unionByName(part(1, 0.9)), "q", "name", "s", 2).withColumn("s", R("s"))


@query("SELECT source, doc_id, round(s, 6) AS score, rank FROM (SELECT source, doc_id, s, row_number() OVER (PARTITION BY source ORDER BY s DESC, created_at DESC, doc_id) AS rank FROM (SELECT source, doc_id, created_at, len(list_intersect(w, ['threshold', 'window', 'residual'])) / 3.0 + 0.01 * r AS s, w FROM (SELECT source, doc_id, created_at, " + _WORDS.format("text") + " AS w, percent_rank() OVER (PARTITION BY source ORDER BY created_at) AS r FROM documents WHERE created_at IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL)) WHERE len(list_intersect(w, ['threshold', 'window', 'residual'])) > 0) WHERE rank <= 5")
def recency_overlap_search(spark, d):
    """The best documents of each source by words and recency."""
    docs = table(spark, d, "documents").where("created_at IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "created_at", _tokens(F.col("text")).alias("w"))
    got = matching.recency_overlap(docs, "source", "created_at", F.col("w"), ["threshold", "window", "residual"], 5)
    return got.select("source", "doc_id", R("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("WITH k AS (SELECT parent_id AS node, list_distinct(list(concept_type)) AS c FROM cdg_nodes WHERE parent_id IS NOT NULL GROUP BY 1), n AS (SELECT node_id, any_value(concept_type) AS t, any_value(len(inputs)) AS i, any_value(len(outputs)) AS o FROM cdg_nodes WHERE inputs IS NOT NULL AND outputs IS NOT NULL GROUP BY 1 HAVING count(DISTINCT concept_type) = 1 AND count(DISTINCT inputs) = 1 AND count(DISTINCT outputs) = 1) SELECT node_id, round(0.25 * CASE WHEN t = 'clustering' THEN 1 ELSE 0 END + 0.15 * CASE WHEN i = 0 AND o = 0 THEN 1 ELSE greatest(0, 1 - 0.15 * (abs(2 - i) + abs(1 - o))) END + 0.25 * len(list_intersect(c, ['clustering', 'sorting'])) / CAST(len(list_distinct(list_concat(c, ['clustering', 'sorting']))) AS DOUBLE) + 0.15 + 0.10 + 0.10, 6) AS score FROM n JOIN k ON k.node = n.node_id")
def graph_alignment(spark, d):
    """The alignment score of every inner node with one query node."""
    c = table(spark, d, "cdg_nodes")
    k = c.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.collect_set("concept_type").alias("c"))
    n = c.where("inputs IS NOT NULL AND outputs IS NOT NULL").groupBy("node_id").agg(F.any_value("concept_type").alias("t"), F.any_value(F.size("inputs")).alias("i"), F.any_value(F.size("outputs")).alias("o"), F.countDistinct("concept_type").alias("x"), F.countDistinct("inputs").alias("y"), F.countDistinct("outputs").alias("z")).where("x = 1 AND y = 1 AND z = 1")
    one = F.lit(1.0)
    s = matching.alignment(concept=F.when(F.col("t") == "clustering", 1.0).otherwise(0.0), io=matching.io_factor(F.lit(2), F.lit(1), F.col("i"), F.col("o")), child=matching.jaccard(F.array(F.lit("clustering"), F.lit("sorting")), F.col("c")), topo=one, type_class=one, witness=one)
    return n.join(k, "node_id").select("node_id", R(s).alias("score"))


@query(f"WITH {_E}, d AS (SELECT node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT parent_id AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT node_id, 1, 0 FROM e) GROUP BY 1), g AS (SELECT graph_id, list(i || ',' || o) AS s FROM (SELECT DISTINCT graph_id, node_id FROM cdg_nodes) n JOIN d ON d.node = n.node_id WHERE graph_id IS NOT NULL GROUP BY 1) SELECT graph_id, round(list_sum(list_transform(list_distinct(s), lambda v: least(len(list_filter(s, lambda x: x = v)), len(list_filter(['0,1', '0,2', '1,0', '1,0', '1,0'], lambda x: x = v))))) / CAST(greatest(len(s), 5) AS DOUBLE), 6) AS topo FROM g")
def degree_sequence_match(spark, d):
    """How far each graph's (in, out) degrees are those of a query graph, as multisets."""
    from tessera.operators import graphs

    n = table(spark, d, "cdg_nodes").select("graph_id", "node_id").where("graph_id IS NOT NULL").distinct()
    g = n.join(graphs.degrees(_edges(spark, d), "parent_id", "node_id").withColumnRenamed("node", "node_id"), "node_id").groupBy("graph_id").agg(F.collect_list(F.concat_ws(",", "n_in", "n_out")).alias("s"))
    return g.select("graph_id", R(matching.multiset_overlap(F.col("s"), F.array(*map(F.lit, ("0,1", "0,2", "1,0", "1,0", "1,0"))))).alias("topo"))


@query("WITH l AS (SELECT p_name AS k, 1 AS layer, 1.0 AS s FROM part WHERE p_size = 7 UNION ALL SELECT p_name, 2, 0.7 * p_size / 50.0 FROM part WHERE p_size > 40 UNION ALL SELECT p_name, 3, 0.5 * p_retailprice / 3000 FROM part), f AS (SELECT k, layer, s FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY layer, s DESC) = 1) SELECT k, CAST(layer AS BIGINT) AS layer, round(s, 6) AS s FROM f ORDER BY layer, s DESC, k LIMIT 40")
def layered_retrieval(spark, d):
    """A cascade of three searches: the first layer that finds a name wins."""
    p = table(spark, d, "part")
    hit = lambda where, n, s: p.where(where).select(F.col("p_name").alias("k"), F.lit(n).cast("bigint").alias("layer"), s.alias("s"))
    hits = hit("p_size = 7", 1, F.lit(1.0)).unionByName(hit("p_size > 40", 2, 0.7 * F.col("p_size") / 50.0)).unionByName(hit("true", 3, 0.5 * F.col("p_retailprice") / 3000))
    return matching.layered(hits, "k", "layer", "s", 40).withColumn("s", R("s"))


@query("WITH r AS (SELECT p_brand, p_type, max(struct_pack(n := len(p_name), name := p_name)) AS b, count(*) AS n_merged FROM part GROUP BY 1, 2) SELECT p_brand, p_type, b.name AS p_name, n_merged FROM r")
def add_with_dedup(spark, d):
    """The richer of duplicates (equal brand and type) is kept."""
    return matching.richest(table(spark, d, "part"), ["p_brand", "p_type"], F.length("p_name"), ["p_name"])


@query(f"WITH a AS (SELECT fingerprint AS f, min({_ID('atom_id')}) AS first, count(DISTINCT {_ID('atom_id')}) AS n FROM atom_versions WHERE fingerprint IS NOT NULL AND atom_id IS NOT NULL AND trim(atom_id) <> '' GROUP BY 1) SELECT f AS fingerprint, first, n FROM a")
def overlapping_fingerprints(spark, d):
    """Fingerprints, the first atom that has each, and how many do."""
    v = table(spark, d, "atom_versions").select(F.col("fingerprint"), norm_id(F.col("atom_id")).alias("a")).where("fingerprint IS NOT NULL AND a IS NOT NULL")
    return v.groupBy("fingerprint").agg(F.min("a").alias("first"), F.countDistinct("a").alias("n"))


@query("SELECT hp_id, NOT (lo IS NOT NULL AND v < lo) AND NOT (hi IS NOT NULL AND v > hi) AS inside FROM (SELECT DISTINCT hp_id, try_cast(min_value AS DOUBLE) AS lo, try_cast(max_value AS DOUBLE) AS hi, try_cast(default_value AS DOUBLE) AS v FROM hyperparams) WHERE v IS NOT NULL")
def validity_bound_match(spark, d):
    """Whether a value's interval lies in the available one, with open ends."""
    n = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    h = table(spark, d, "hyperparams").select("hp_id", n("min_value").alias("lo"), n("max_value").alias("hi"), n("default_value").alias("v")).distinct().where("v IS NOT NULL")
    return h.select("hp_id", matching.interval_inside(F.col("v"), F.col("v"), F.col("lo"), F.col("hi")).alias("inside"))


@query(f"SELECT atom_id, round(CAST(2.0 * CASE WHEN pub THEN 1 ELSE 0 END + 0.8 * CASE WHEN status = 'approved' THEN 1 ELSE 0 END + CASE WHEN kind = 'generated' THEN 0.3 ELSE 0.5 END AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY 2.0 * CASE WHEN pub THEN 1 ELSE 0 END + 0.8 * CASE WHEN status = 'approved' THEN 1 ELSE 0 END + CASE WHEN kind = 'generated' THEN 0.3 ELSE 0.5 END DESC, fqdn DESC, atom_id DESC) AS rank FROM (SELECT {_ID('atom_id')} AS atom_id, max(fqdn) AS fqdn, bool_or(is_publishable) AS pub, max(status) AS status, max(coalesce(source_kind, '')) AS kind FROM atoms WHERE atom_id IS NOT NULL AND trim(atom_id) <> '' GROUP BY 1) ORDER BY rank LIMIT 50")
def ranked_candidates(spark, d):
    """Candidates by weighted trust and provenance; the first fifty."""
    a = table(spark, d, "atoms").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.max("fqdn").alias("fqdn"), F.bool_or("is_publishable").alias("pub"), F.max("status").alias("status"), F.max(F.coalesce("source_kind", F.lit(""))).alias("kind")).where("atom_id IS NOT NULL")
    s = a.withColumn("s", 2.0 * F.coalesce(F.col("pub").cast("int"), F.lit(0)) + 0.8 * F.coalesce((F.col("status") == "approved").cast("int"), F.lit(0)) + F.when(F.col("kind") == "generated", 0.3).otherwise(0.5))
    top = s.orderBy(F.col("s").desc(), F.col("fqdn").desc(), F.col("atom_id").desc()).limit(50)  # ranks are given to fifty rows only
    w = Window.orderBy(F.col("s").desc(), F.col("fqdn").desc(), F.col("atom_id").desc())
    return top.select("atom_id", R("s").alias("score"), F.row_number().over(w).cast("bigint").alias("rank"))


# --- ledgers, rules and credit


@query("SELECT o_orderkey, round(0.5 * o_totalprice / 1000 - 0.3 * (o_orderkey % 17), 6) AS score FROM orders")
def scalarized_rank(spark, d):
    """Weighted objectives in one number; those to be maximised count negative."""
    return table(spark, d, "orders").select("o_orderkey", R(0.5 * F.col("o_totalprice") / 1000 - 0.3 * (F.col("o_orderkey") % 17)).alias("score"))


@query("SELECT node_id, substr(sha256(coalesce(p, '') || '|' || coalesce(t, '') || '|' || array_to_string(list_sort(list_filter(list_transform(coalesce(i, []), lambda x: x.type_desc), lambda x: x IS NOT NULL)), ',')), 1, 16) AS slot FROM (SELECT DISTINCT node_id, parent_id AS p, concept_type AS t, inputs AS i FROM cdg_nodes)")
def slot_signature(spark, d):
    """A short hash of a node's parent, concept and sorted port types."""
    types = F.array_join(F.sort_array(F.filter(F.transform(F.coalesce("inputs", F.array()), lambda x: x["type_desc"]), lambda x: x.isNotNull())), ",")
    n = table(spark, d, "cdg_nodes").select("node_id", F.coalesce("parent_id", F.lit("")).alias("p"), F.coalesce("concept_type", F.lit("")).alias("t"), F.coalesce(types, F.lit("")).alias("s"), "inputs").distinct()
    return n.select("node_id", F.substring(F.sha2(F.concat_ws("|", "p", "t", "s"), 256), 1, 16).alias("slot"))


@query(f"SELECT fqdn, count(*) AS n, round(avg(1 / (1 + abs(metric_value))), 6) AS prior FROM (SELECT {_NAME('atom_fqdn')} AS fqdn, metric_value FROM benchmarks WHERE isfinite(metric_value)) WHERE fqdn <> '' GROUP BY 1")
def atom_prior(spark, d):
    """The mean reward over an atom's benchmarks."""
    b = table(spark, d, "benchmarks").where("NOT isnan(metric_value) AND abs(metric_value) < double('infinity')").select(norm_name(F.col("atom_fqdn")).alias("fqdn"), "metric_value").where("fqdn IS NOT NULL")
    return b.groupBy("fqdn").agg(F.count(F.lit(1)).alias("n"), R(F.avg(1 / (1 + F.abs("metric_value")))).alias("prior"))


@query(f"WITH {_E}, n AS (SELECT parent_id AS node FROM e UNION SELECT node_id FROM e) SELECT node, round(1.0 / (SELECT count(*) FROM n), 12) AS share FROM n")
def shapley_values(spark, d):
    """Each node of the graph has the same share."""
    e = _edges(spark, d)
    n = e.select(F.col("parent_id").alias("node")).unionByName(e.select(F.col("node_id").alias("node"))).distinct()
    total = n.agg(F.count(F.lit(1)).alias("_n"))
    return n.crossJoin(F.broadcast(total)).select("node", F.round(1 / F.col("_n"), 12).alias("share"))  # one row


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) * 100 AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round(s, 6) AS share FROM r")
def credit_latency(spark, d):
    """Each part's share of its whole, in per cent."""
    return telemetry.share_of_total(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], F.col("l_extendedprice"), "share").select("l_orderkey", "l_linenumber", R("share").alias("share"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, coalesce(abs(l_discount) * (1 - l_tax), l_quantity) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(v) OVER w <> 0 THEN 100 * v / sum(v) OVER w ELSE 0 END, 6) AS share FROM p WINDOW w AS (PARTITION BY l_orderkey)")
def credit_precision(spark, d):
    """Shares of gradient times confidence, or else of the error's growth."""
    v = F.coalesce(F.abs("l_discount") * (1 - F.col("l_tax")), F.col("l_quantity"))
    return telemetry.share_of_total(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity"), ["l_orderkey"], v, "share").select("l_orderkey", "l_linenumber", R("share").alias("share"))


@query("WITH w AS (SELECT node_id, graph_id, CASE WHEN matched_primitive IS NULL THEN 1.0 ELSE 0 END + CASE WHEN status = 'rejected' THEN 3.0 ELSE 0 END AS v FROM (SELECT DISTINCT node_id, graph_id, matched_primitive, status FROM cdg_nodes WHERE graph_id IS NOT NULL)) SELECT node_id, graph_id, round(CASE WHEN sum(v) OVER g <> 0 THEN 100 * v / sum(v) OVER g ELSE 0 END, 6) AS share FROM w WINDOW g AS (PARTITION BY graph_id)")
def credit_structure(spark, d):
    """Shares of the weights of what is wrong with a node."""
    n = table(spark, d, "cdg_nodes").where("graph_id IS NOT NULL").select("node_id", "graph_id", "matched_primitive", "status").distinct()
    v = F.col("matched_primitive").isNull().cast("double") + F.when(F.col("status") == "rejected", 3.0).otherwise(0.0)
    return telemetry.share_of_total(n, ["graph_id"], v, "share").select("node_id", "graph_id", R("share").alias("share"))


@query(f"SELECT user_id, count(*) AS n, round(max({_T}) - min({_T}), 6) AS seconds FROM events GROUP BY 1 HAVING max({_T}) > min({_T}) AND count(*) / ((max({_T}) - min({_T})) / 60) < 0.01")
def minimum_count_rule(spark, d):
    """Users with too few events a minute."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(t) - F.min(t), 6).alias("seconds"))
    return telemetry.too_few(g, "n", "seconds", 0.01)


@query("SELECT benchmark_id, CASE WHEN metric_value IS NULL OR CAST(metric_value AS VARCHAR) LIKE '%nan' THEN 'unknown' WHEN metric_value < 0 THEN 'reject' WHEN metric_value < 0.5 THEN 'warn' ELSE 'pass' END AS outcome FROM benchmarks")
def threshold_rule(spark, d):
    v = F.col("metric_value")
    return table(spark, d, "benchmarks").select("benchmark_id", F.when(v.isNull() | F.isnan(v), "unknown").when(v < 0, "reject").when(v < 0.5, "warn").otherwise("pass").alias("outcome"))


@query("SELECT status, count(*) AS n_trials, CAST(sum(events_count) AS BIGINT) AS n_decisions, count(*) FILTER (error IS NOT NULL) AS n_pruned FROM pipeline_runs GROUP BY 1")
def search_discipline(spark, d):
    return table(spark, d, "pipeline_runs").groupBy("status").agg(F.count(F.lit(1)).alias("n_trials"), F.sum("events_count").cast("bigint").alias("n_decisions"), F.count("error").alias("n_pruned"))


@query("WITH e AS (SELECT event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gain FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (gain > 0) AS n_positive, round(avg(gain) FILTER (gain > 0), 6) AS mean_gain, round(max(gain), 6) AS best FROM e WHERE gain IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (gain > 0) >= 2")
def heuristic_outcomes(spark, d):
    """Gains by kind, of kinds with at least two positive ones."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", (F.col("value") - F.lag("value").over(w)).alias("gain")).where("gain IS NOT NULL")
    pos = F.when(F.col("gain") > 0, F.col("gain"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(pos).alias("n_positive"), R(F.avg(pos)).alias("mean_gain"), R(F.max("gain")).alias("best")).where("n_positive >= 2")


@query("WITH a AS (SELECT o_orderkey AS k, o_totalprice AS x FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 30 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS x FROM orders) SELECT count(*) AS n, round(avg(CASE WHEN abs(a.x - b.x) <= 1e-10 THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN abs(a.x - b.x) <= 1e-10 THEN 1 ELSE 0 END) >= 0.95 AS equivalent FROM a JOIN b USING (k)")
def behavioral_equivalence(spark, d):
    """Whether two functions' outputs agree on the same inputs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    b = o.select("k", F.when(F.col("k") % 30 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("y"))
    s = o.join(b, "k").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("x") - F.col("y")) <= 1e-10).cast("int")).alias("s"))
    return s.select("n", R("s").alias("share"), (F.col("s") >= 0.95).alias("equivalent"))


@query("SELECT p_brand, count(*) AS n_values, round(sum(p_retailprice), 2) AS total, CAST(max(h) AS BIGINT) AS h_index FROM (SELECT p_brand, p_retailprice, CASE WHEN p_size >= row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) THEN row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) ELSE 0 END AS h FROM part) GROUP BY 1")
def impact_factor(spark, d):
    """Count, sum and h-index of each group's values."""
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey"))
    p = table(spark, d, "part").withColumn("r", r)
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.max(F.when(F.col("p_size") >= F.col("r"), F.col("r")).otherwise(0)).cast("bigint").alias("h_index"))


# --- telemetry


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error') ORDER BY ts DESC, event_id LIMIT 100 OFFSET 50")
def list_events(spark, d):
    """One page of the filtered events, latest first."""
    return telemetry.page(table(spark, d, "events").where("event_type IN ('click', 'error')").select("event_id", "user_id", "event_type", "ts"), [F.col("ts").desc(), "event_id"], 50, 100).drop("ts")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' OR props LIKE '%error%'")
def list_events_for_errors(spark, d):
    return table(spark, d, "events").where((F.col("event_type") == "error") | F.col("props").contains("error")).select("event_id", "user_id")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_done, count(*) FILTER (event_type = 'error') AS n_error FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def list_events_for_coverage(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n_done"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_error"))


@query("SELECT user_id, event_type, max(struct_pack(ts := ts, id := event_id)).id AS last_event, count(*) AS completed FROM events GROUP BY 1, 2")
def stage_progress(spark, d):
    """The last state of each stage of each run, and how often it was reported."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("l"), F.count(F.lit(1)).alias("completed")).select("user_id", "event_type", F.col("l.event_id").alias("last_event"), "completed")


@query("SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def metadata_counter(spark, d):
    """A nested counter as the sum of its increments."""
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("WITH g AS (SELECT event_type, list_sort(list_distinct(list(CAST(event_id % 2 AS VARCHAR)))) AS p FROM events GROUP BY 1) SELECT event_type, array_to_string(p, ',') AS paths, p = ['0'] AND event_type IN ('click', 'error') OR (p = ['1'] AND event_type = 'view') AS ok FROM g WHERE event_type IN ('click', 'error', 'view')")
def flow_execution_paths(spark, d):
    """Variants and the paths they took, against the expected one."""
    e = table(spark, d, "events").where("event_type IN ('click', 'error', 'view')").withColumn("path", (F.col("event_id") % 2).cast("string"))
    return telemetry.path_check(e, "event_type", "path", {"click": "0", "error": "0", "view": "1"})


@query("WITH g AS (SELECT event_type, round(avg(value), 3) AS mean FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1), o AS (SELECT *, list_position(['view', 'click', 'purchase'], event_type) AS i FROM g) SELECT event_type, mean, coalesce(mean < lag(mean) OVER (ORDER BY i), FALSE) AS violates FROM o")
def flow_prompt_volume(spark, d):
    return telemetry.ordered_means(table(spark, d, "events"), "event_type", "value", ["view", "click", "purchase"])


@query("WITH g AS (SELECT event_type, avg(value) AS v, avg(event_id % 13) AS i FROM events GROUP BY 1), b AS (SELECT v AS bv, i AS bi FROM g WHERE event_type = 'view') SELECT event_type, round(v - bv, 4) AS d_value, round(i - bi, 4) AS d_i FROM g, b WHERE event_type <> 'view'")
def single_agent_comparison(spark, d):
    """Each variant's means less those of one variant."""
    return telemetry.deltas(table(spark, d, "events").select("event_type", "value", (F.col("event_id") % 13).alias("i")), "event_type", "view", ["value", "i"])


# --- parsers


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, CAST(l_extendedprice AS DOUBLE) AS uncertainty FROM lineitem")
def fixed_width_constants(spark, d):
    """A fixed-width table of names, values and uncertainties, read by columns; lines that don't read are skipped."""
    at = _scratch(spark)
    t = table(spark, d, "lineitem").select(F.concat(F.rpad(F.concat_ws("-", "l_orderkey", "l_linenumber"), 30, " "), F.rpad(F.col("l_quantity").cast("string"), 25, " "), F.rpad(F.col("l_extendedprice").cast("string"), 25, " ")).alias("value"))
    t.unionByName(spark.createDataFrame([("Quantity   Value   Uncertainty",), ("-" * 60,), ("",)], "value string")).write.text(at)
    return files.fixed_width(spark, at, [30, 25, 25]).select(F.split("c0", "-")[0].cast("bigint").alias("l_orderkey"), F.split("c0", "-")[1].cast("int").alias("l_linenumber"), F.col("c1").cast("double").alias("value"), F.col("c2").cast("double").alias("uncertainty"))


@query("SELECT evidence_id, sha256(evidence_id || '|' || coalesce(run_id, '')) AS candidate_id, 'snap-1' AS snapshot_id FROM (SELECT DISTINCT evidence_id, run_id FROM runtime_evidence)")
def staged_candidates(spark, d):
    """Deterministic ids from content, and the snapshot the rows belong to."""
    r = table(spark, d, "runtime_evidence").select("evidence_id", "run_id").distinct()
    return r.select("evidence_id", F.sha2(F.concat("evidence_id", F.lit("|"), F.coalesce("run_id", F.lit(""))), 256).alias("candidate_id"), F.lit("snap-1").alias("snapshot_id"))


@query(f"WITH k AS (SELECT DISTINCT {_NAME('atom_fqdn')} AS f FROM benchmarks WHERE {_NAME('atom_fqdn')} <> ''), s AS (SELECT DISTINCT {_NAME('fqdn')} AS f FROM atoms), l AS (SELECT regexp_replace(f, '^.*[.]', '') AS leaf, count(*) AS n FROM s GROUP BY 1) SELECT k.f AS fqdn, CASE WHEN s.f IS NOT NULL THEN 'exact' WHEN l.n = 1 THEN 'candidate' ELSE 'unresolved' END AS kind FROM k LEFT JOIN s ON s.f = k.f LEFT JOIN l ON l.leaf = regexp_replace(k.f, '^.*[.]', '')")
def classify_fqdns(spark, d):
    """Names that are seeded, that have one canonical candidate, or neither."""
    leaf = lambda c: F.regexp_replace(c, r"^.*[.]", "")
    k = table(spark, d, "benchmarks").select(norm_name(F.col("atom_fqdn")).alias("fqdn")).where("fqdn IS NOT NULL").distinct()
    s = table(spark, d, "atoms").select(norm_name(F.col("fqdn")).alias("fqdn")).where("fqdn IS NOT NULL").distinct()
    n = s.groupBy(leaf("fqdn").alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    j = k.join(s.withColumn("here", F.lit(True)), "fqdn", "left").withColumn("leaf", leaf("fqdn")).join(n, "leaf", "left")
    return j.select("fqdn", F.when(F.col("here"), "exact").when(F.col("n") == 1, "candidate").otherwise("unresolved").alias("kind"))


_FAMILIES = [("Brand#12", "twelve"), ("Brand#1", "ones"), ("Brand#", "brands")]


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'twelve' WHEN starts_with(p_brand, 'Brand#1') THEN 'ones' WHEN starts_with(p_brand, 'Brand#') THEN 'brands' ELSE 'other' END AS family FROM part")
def source_family(spark, d):
    """The family of the longest prefix that fits."""
    f = None
    for p, n in sorted(_FAMILIES, key=lambda x: -len(x[0])):
        f = F.when(F.col("p_brand").startswith(p), n) if f is None else f.when(F.col("p_brand").startswith(p), n)
    return table(spark, d, "part").select("p_partkey", f.otherwise("other").alias("family"))


@query(f"WITH a AS (SELECT {_ID('atom_id')} AS atom_id, bool_or(is_publishable AND visibility_tier = 'general') AS ok FROM atoms GROUP BY 1) SELECT DISTINCT io_spec_id, {_ID('atom_id')} AS atom_id, port_name FROM io_specs WHERE {_ID('atom_id')} IN (SELECT atom_id FROM a WHERE ok AND atom_id <> '')")
def manifest_children(spark, d):
    """The children of the atoms that a tier may see."""
    a = table(spark, d, "atoms").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.bool_or((F.col("is_publishable") & (F.col("visibility_tier") == "general"))).alias("ok")).where("ok AND atom_id IS NOT NULL")
    return table(spark, d, "io_specs").select("io_spec_id", norm_id(F.col("atom_id")).alias("atom_id"), "port_name").join(a.select("atom_id"), "atom_id", "left_semi").distinct()


@query(f"WITH a AS (SELECT {_ID('atom_id')} AS atom_id, max(fqdn) AS fqdn, max(description) AS description FROM atoms GROUP BY 1), p AS (SELECT {_ID('atom_id')} AS atom_id, count(DISTINCT port_name) FILTER (direction = 'input') AS n_in, count(DISTINCT port_name) FILTER (direction = 'output') AS n_out FROM io_specs GROUP BY 1) SELECT atom_id, fqdn, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM a LEFT JOIN p USING (atom_id) WHERE atom_id <> '' AND fqdn NOT IN (SELECT matched_primitive FROM cdg_nodes WHERE matched_primitive IS NOT NULL)")
def seed_primitives(spark, d):
    """Atoms with their port counts as primitives, but those that are installed already."""
    a = table(spark, d, "atoms").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.max("fqdn").alias("fqdn")).where("atom_id IS NOT NULL AND fqdn IS NOT NULL")
    p = table(spark, d, "io_specs").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(*[F.countDistinct(F.when(F.col("direction") == k, F.col("port_name"))).alias(n) for k, n in (("input", "n_in"), ("output", "n_out"))])
    there = table(spark, d, "cdg_nodes").select(F.col("matched_primitive").alias("fqdn")).where("fqdn IS NOT NULL")
    return a.join(there, "fqdn", "left_anti").join(p, "atom_id", "left").select("atom_id", "fqdn", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query(f"WITH m AS (SELECT DISTINCT {_ID('atom_id')} AS atom_id, coalesce({_ID('status')}, '') AS status FROM manifest_atoms), a AS (SELECT {_ID('atom_id')} AS atom_id, arg_max(coalesce({_ID('status')}, ''), loaded_at) AS status FROM atoms GROUP BY 1) SELECT coalesce(a.atom_id, m.atom_id) AS atom_id, coalesce(a.status, min(m.status)) AS status, CASE WHEN m.atom_id IS NULL THEN 'inserted' WHEN a.atom_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM a FULL JOIN m ON a.atom_id = m.atom_id WHERE coalesce(a.atom_id, m.atom_id) <> '' GROUP BY a.atom_id, m.atom_id, a.status")
def manifest_ingest(spark, d):
    """A keyed upsert: the new rows win, old ones that they don't name are kept."""
    low = lambda c: F.coalesce(F.lower(norm_name(F.col(c))), F.lit(""))
    old = table(spark, d, "manifest_atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), F.struct(F.lit(0).alias("k"), F.lit(None).cast("timestamp_ntz").alias("at"), low("status").alias("status")).alias("r"))
    new = table(spark, d, "atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), F.struct(F.lit(1).alias("k"), F.col("loaded_at").cast("timestamp_ntz").alias("at"), low("status").alias("status")).alias("r"))
    g = old.unionByName(new).where("atom_id IS NOT NULL").groupBy("atom_id").agg(F.max("r").alias("r"), F.min("r.k").alias("lo"), F.min(F.when(F.col("r.k") == 0, F.col("r.status"))).alias("s"))
    return g.select("atom_id", F.when(F.col("r.k") == 1, F.col("r.status")).otherwise(F.col("s")).alias("status"), F.when(F.col("lo") == 1, "inserted").when(F.col("r.k") == 0, "kept").otherwise("updated").alias("outcome"))


@query(f"WITH o AS (SELECT DISTINCT {_ID('atom_id')} AS k FROM manifest_atoms), n AS (SELECT DISTINCT {_ID('atom_id')} AS k FROM atoms) SELECT k AS atom_id FROM o WHERE k <> '' AND k NOT IN (SELECT k FROM n WHERE k IS NOT NULL)")
def stale_nodes(spark, d):
    """Stored keys that the new graph no longer holds, to be deleted after an upsert."""
    key = lambda n: table(spark, d, n).select(norm_id(F.col("atom_id")).alias("atom_id")).where("atom_id IS NOT NULL").distinct()
    return key("manifest_atoms").join(key("atoms"), "atom_id", "left_anti")


@query("SELECT hp_id, lo <= 10 AND hi >= 0 AS overlaps FROM (SELECT DISTINCT hp_id, try_cast(min_value AS DOUBLE) AS lo, try_cast(max_value AS DOUBLE) AS hi FROM hyperparams) WHERE lo IS NOT NULL AND hi IS NOT NULL")
def range_overlaps(spark, d):
    """Whether a parameter's bounds overlap a range, ends included."""
    n = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    h = table(spark, d, "hyperparams").select("hp_id", n("min_value").alias("lo"), n("max_value").alias("hi")).distinct().where("lo IS NOT NULL AND hi IS NOT NULL")
    return h.select("hp_id", (matching.le_fuzzy(F.col("lo"), F.lit(10.0)) & matching.ge_fuzzy(F.col("hi"), F.lit(0.0))).alias("overlaps"))


@query("SELECT atom_id, names, len(list_filter(names, lambda k: NOT list_contains(['alpha', 'beta', 'gamma', 'threshold', 'window'], k))) = 0 AS contained FROM (SELECT " + _ID("atom_id") + " AS atom_id, list_sort(list(DISTINCT name)) AS names FROM hyperparams WHERE name IS NOT NULL GROUP BY 1) WHERE atom_id <> ''")
def variables_contained(spark, d):
    """Whether all variables of a candidate are columns of the data."""
    h = table(spark, d, "hyperparams").where("name IS NOT NULL").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.sort_array(F.collect_set("name")).alias("names")).where("atom_id IS NOT NULL")
    return h.select("atom_id", "names", (F.size(F.array_except("names", F.array(*map(F.lit, ("alpha", "beta", "gamma", "threshold", "window"))))) == 0).alias("contained"))


# --- more searches

_ASK = ["window", "threshold", "residual"]
_FTS = "list_filter(['window', 'threshold', 'residual'], lambda t: list_contains(w, t))"


@query(f"WITH a AS (SELECT {_ID('atom_id')} AS atom_id, max(fqdn) AS fqdn, max(coalesce(description, '')) AS body, max(coalesce(domain_tags, '')) AS tags FROM atoms GROUP BY 1), w AS (SELECT atom_id, {_WORDS.format('fqdn')} AS a, {_WORDS.format('body')} AS b, {_WORDS.format('tags')} AS c FROM a WHERE atom_id <> ''), s AS (SELECT atom_id, len(list_intersect(a, {_ASK})) * 1.0 + len(list_intersect(b, {_ASK})) * 0.4 + len(list_intersect(c, {_ASK})) * 0.2 AS s FROM w) SELECT atom_id, CAST(round(s, 6) AS DOUBLE) AS score FROM s WHERE s > 0")
def fts_weighted(spark, d):
    """Any-word search over weighted parts of a record: its name, its description, its tags."""
    a = table(spark, d, "atoms").groupBy(norm_id(F.col("atom_id")).alias("atom_id")).agg(F.max("fqdn").alias("fqdn"), F.max(F.coalesce("description", F.lit(""))).alias("body"), F.max(F.coalesce("domain_tags", F.lit(""))).alias("tags")).where("atom_id IS NOT NULL")
    q = F.array(*map(F.lit, _ASK))
    s = sum((w * F.size(F.array_intersect(_tokens(F.col(c)), q)) for c, w in (("fqdn", 1.0), ("body", 0.4), ("tags", 0.2))), F.lit(0.0))
    return a.select("atom_id", R(s).alias("score")).where("score > 0")


@query(f"SELECT doc_id, round(least(len(list_intersect(w, {_ASK})) * 0.1, 0.3)::DOUBLE, 6) AS bonus FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL)")
def type_bonus(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", R(matching.type_bonus(F.array(*map(F.lit, _ASK)), _tokens(F.col("text")))).alias("bonus"))


@query(f"WITH p AS (SELECT DISTINCT fqdn, {_WORDS.format('fqdn')} AS w FROM atoms WHERE fqdn IS NOT NULL), o AS (SELECT fqdn, len(list_intersect(w, ['atoms', 'window', 'threshold'])) / CAST(greatest(len(w), 1) AS DOUBLE) AS s FROM p) SELECT count(*) FILTER (s >= 0.2) AS n_strong, round(max(s), 6) AS max_overlap, round(least(0.25, count(*) FILTER (s >= 0.2) * 0.05) + least(0.2, max(s) * 0.5), 6) AS score FROM o")
def catalog_confidence(spark, d):
    """Whether a search of the catalog is likely to pay off for a text."""
    w = _tokens(F.col("fqdn"))
    p = table(spark, d, "atoms").where("fqdn IS NOT NULL").select("fqdn").distinct()
    o = p.select((F.size(F.array_intersect(w, F.array(*map(F.lit, ("atoms", "window", "threshold"))))) / F.greatest(F.size(w), F.lit(1))).alias("s")).agg(F.count(F.when(F.col("s") >= 0.2, 1)).alias("n_strong"), F.max("s").alias("m"))
    return o.select("n_strong", R("m").alias("max_overlap"), R(F.least(F.lit(0.25), F.col("n_strong") * 0.05) + F.least(F.lit(0.2), F.col("m") * 0.5)).alias("score"))


_GOAL, _TAGS = ["align", "window", "signal"], ["filter", "residual"]


@query(f"SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, 0.30 * j(w, {_GOAL}) + 0.20 * j(w, {_TAGS}) + 0.12 * CASE WHEN doc_kind = 'technical' THEN 1.0 ELSE 0 END AS s FROM (SELECT doc_id, doc_kind, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL)) WHERE s >= 0.05".replace(f"j(w, {_GOAL})", f"(len(list_intersect(w, {_GOAL})) / CAST(len(list_distinct(list_concat(w, {_GOAL}))) AS DOUBLE))").replace(f"j(w, {_TAGS})", f"(len(list_intersect(w, {_TAGS})) / CAST(len(list_distinct(list_concat(w, {_TAGS}))) AS DOUBLE))"))
def trick_retrieval(spark, d):
    """Records by weighted overlaps of goal and tags, and an equal family."""
    w, arr = _tokens(F.col("text")), lambda x: F.array(*map(F.lit, x))
    s = 0.30 * matching.jaccard(w, arr(_GOAL)) + 0.20 * matching.jaccard(w, arr(_TAGS)) + 0.12 * F.when(F.col("doc_kind") == "technical", 1.0).otherwise(0.0)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", s.alias("s")).where("s >= 0.05").select("doc_id", R("s").alias("score"))


@query("WITH b AS (SELECT node_id, any_value(name) AS name, max(len(list_intersect(" + _WORDS.format("coalesce(name, '')") + ", ['merge', 'sort', 'filter', 'estimate'])) / 4.0) AS s FROM cdg_nodes GROUP BY 1) SELECT node_id, CAST(round(s, 6) AS DOUBLE) AS best FROM b WHERE s < 0.6")
def catalog_gaps(spark, d):
    """Nodes whose best match stays below a ceiling."""
    n = table(spark, d, "cdg_nodes").select("node_id", (F.size(F.array_intersect(_tokens(F.coalesce("name", F.lit(""))), F.array(*map(F.lit, ("merge", "sort", "filter", "estimate"))))) / 4.0).alias("s")).groupBy("node_id").agg(F.max("s").alias("best"))
    return matching.weak_spots(n, "best", 0.6).withColumn("best", R("best"))


# --- more of graphs


@query("WITH n AS (SELECT node_id, min(concept_type) AS t FROM cdg_nodes GROUP BY 1), " + _E.replace("e AS", "e AS") + " SELECT e.parent_id, e.node_id FROM e JOIN n a ON a.node_id = e.parent_id JOIN n b ON b.node_id = e.node_id WHERE a.t = 'signal_filter' AND b.t = 'signal_transform' AND e.parent_id <> e.node_id ORDER BY 1, 2 LIMIT 1")
def rewrite_match(spark, d):
    """The first match of a pattern of two nodes and an edge; no node stands for two."""
    n = table(spark, d, "cdg_nodes").groupBy("node_id").agg(F.min("concept_type").alias("t"))
    e = _edges(spark, d).where("parent_id <> node_id")
    a = n.where("t = 'signal_filter'").select(F.col("node_id").alias("parent_id"))
    b = n.where("t = 'signal_transform'").select("node_id")
    return e.join(a, "parent_id", "left_semi").join(b, "node_id", "left_semi").select("parent_id", "node_id").orderBy("parent_id", "node_id").limit(1)


@query("WITH " + _E + ", x AS (SELECT DISTINCT node_id FROM cdg_nodes WHERE status = 'rejected') SELECT parent_id, node_id FROM e WHERE (node_id IN (SELECT node_id FROM x)) <> (parent_id IN (SELECT node_id FROM x))")
def gluing_violations(spark, d):
    """Edges between nodes that a rule deletes and others, which would be left dangling."""
    x = table(spark, d, "cdg_nodes").where("status = 'rejected'").select("node_id").distinct()
    e = _edges(spark, d)
    gone = lambda side, name: x.select(F.col("node_id").alias(side), F.lit(True).alias(name))
    j = e.join(gone("node_id", "_a"), "node_id", "left").join(gone("parent_id", "_b"), "parent_id", "left")
    return j.where(F.coalesce("_a", F.lit(False)) != F.coalesce("_b", F.lit(False))).select("parent_id", "node_id")


@query("SELECT node_id, concept_type, n_in, round(coverage * (0.60 + 0.20 * CASE WHEN n_in = 0 THEN 1 ELSE greatest(0, 1 - 0.15 * abs(2 - n_in)) END + 0.10 * CASE WHEN concept_type = 'clustering' THEN 1 ELSE 0 END), 6) AS score FROM (SELECT DISTINCT node_id, concept_type, coalesce(len(inputs), 0) AS n_in, 0.8 + (depth % 3) / 10.0 AS coverage FROM cdg_nodes WHERE depth >= 0 AND status = 'atomic') ")
def refinement_templates(spark, d):
    """Verified nodes by coverage and how far ports and concept suit."""
    n = table(spark, d, "cdg_nodes").where("depth >= 0 AND status = 'atomic'").select("node_id", "concept_type", F.greatest(F.coalesce(F.size("inputs"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_in"), (F.lit(0.8) + (F.col("depth") % 3) / 10.0).alias("c")).distinct()
    io = F.when(F.col("n_in") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.15 * F.abs(2 - F.col("n_in"))))
    return n.select("node_id", "concept_type", "n_in", R(F.col("c") * (0.60 + 0.20 * io + 0.10 * F.when(F.col("concept_type") == "clustering", 1.0).otherwise(0.0))).alias("score"))


@query(f"WITH RECURSIVE {_E}, n AS (SELECT parent_id AS node FROM e UNION SELECT node_id FROM e), t AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT node_id FROM e) UNION ALL SELECT e.node_id, t.level + 1 FROM e JOIN t ON e.parent_id = t.node), l AS (SELECT node, max(level) AS level FROM t GROUP BY 1), k AS (SELECT node_id, min(concept_type) AS t, min(graph_id) AS g FROM cdg_nodes GROUP BY 1) SELECT node, CAST(level AS BIGINT) AS level, t = 'map' OR t = 'fixed_point' AS body FROM l JOIN k ON k.node_id = node")
def combinator_levels(spark, d):
    """Levels with a mark on nodes whose body is emitted with them."""
    from tessera.operators import graphs

    k = table(spark, d, "cdg_nodes").groupBy(F.col("node_id").alias("node")).agg(F.min("concept_type").alias("t"))
    return graphs.topo_levels(_edges(spark, d), "parent_id", "node_id").where("level IS NOT NULL").join(k, "node").select("node", "level", F.col("t").isin("map", "fixed_point").alias("body"))


@query("SELECT DISTINCT node_id, graph_id, name, concept_type, coalesce(len(inputs), 0) AS n_in, coalesce(len(outputs), 0) AS n_out, CASE WHEN parent_id IS NULL OR trim(parent_id) = '' THEN 'boundary' WHEN is_optional THEN 'lossy' ELSE 'exact' END AS edge_class FROM cdg_nodes")
def published_projection(spark, d):
    """Nodes as published rows, with the class of the edge to their parent."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return table(spark, d, "cdg_nodes").select("node_id", "graph_id", "name", "concept_type", n("inputs").alias("n_in"), n("outputs").alias("n_out"), F.when(F.col("parent_id").isNull() | (F.trim("parent_id") == ""), "boundary").when(F.col("is_optional"), "lossy").otherwise("exact").alias("edge_class")).distinct()


@query("WITH x AS (SELECT DISTINCT node_id, status, coalesce(len(inputs), 0) AS n FROM cdg_nodes) SELECT status, CASE WHEN n > 4 THEN 'large' WHEN n > 1 THEN 'medium' ELSE 'small' END AS tier, count(*) AS n_nodes FROM x GROUP BY 1, 2")
def prescreen_tiers(spark, d):
    n = table(spark, d, "cdg_nodes").select("node_id", "status", F.greatest(F.coalesce(F.size("inputs"), F.lit(0)), F.lit(0)).alias("n")).distinct()
    return n.groupBy("status", F.when(F.col("n") > 4, "large").when(F.col("n") > 1, "medium").otherwise("small").alias("tier")).agg(F.count(F.lit(1)).alias("n_nodes"))


# --- more of rules, credit and parsers


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(v) OVER w <> 0 THEN 100 * v / sum(v) OVER w ELSE 0 END, 6) AS memory, round(100.0 / count(*) OVER w, 6) AS convergence FROM p WINDOW w AS (PARTITION BY l_orderkey)")
def credit_memory(spark, d):
    """Shares of peak memory, and equal shares over the parts of a loop."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    m = telemetry.share_of_total(t, ["l_orderkey"], F.col("l_quantity"), "memory")
    return telemetry.share_of_total(m, ["l_orderkey"], F.lit(1.0), "convergence").select("l_orderkey", "l_linenumber", R("memory").alias("memory"), R("convergence").alias("convergence"))


@query("WITH i AS (SELECT user_id, event_id % 40 AS pos FROM events), s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, epoch(ts) AS t FROM events) SELECT i.user_id, i.pos, CASE WHEN s.t IS NULL THEN 'out of bounds' END AS problem, round(s.t, 6) AS t FROM (SELECT DISTINCT * FROM i) i LEFT JOIN s USING (user_id, pos)")
def prediction_times(spark, d):
    """Indices looked up in their series' times, with those that lie outside."""
    e = table(spark, d, "events")
    i = e.select("user_id", (F.col("event_id") % 40).alias("pos")).distinct()
    s = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1).alias("pos"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6).alias("t"))
    return i.join(s, ["user_id", "pos"], "left").select("user_id", "pos", F.when(F.col("t").isNull(), "out of bounds").alias("problem"), "t")


@query("SELECT s_suppkey, (s_suppkey % 4 + 1) * 3 = (s_nationkey % 3 + 1) * 2 AS compatible FROM supplier")
def exponent_compatibility(spark, d):
    """Whether exponents (a, 2) and (b, 3) over two shared names are in equal ratio."""
    one = F.array((F.col("s_suppkey") % 4 + 1).cast("double"), F.lit(2.0))
    two = F.array((F.col("s_nationkey") % 3 + 1).cast("double"), F.lit(3.0))
    return table(spark, d, "supplier").select("s_suppkey", matching.equal_ratios(one, two).alias("compatible"))


@query("SELECT DISTINCT n.node_id FROM cdg_nodes n JOIN cdg_nodes p ON p.node_id = n.parent_id WHERE (p.parent_id IS NULL OR trim(p.parent_id) = '') AND n.is_optional AND len(n.inputs) > 0")
def root_boundary_loss(spark, d):
    """Lossy edges that leave a root's input."""
    c = table(spark, d, "cdg_nodes")
    roots = c.where("parent_id IS NULL OR trim(parent_id) = ''").select(F.col("node_id").alias("parent_id")).distinct()
    return c.where("is_optional").where(F.size("inputs") > 0).join(roots, "parent_id", "left_semi").select("node_id").distinct()


@query("WITH x AS (SELECT event_type, CASE WHEN value > 30 THEN 'selected' WHEN value > 10 THEN 'rejected' ELSE 'skipped' END AS outcome, value FROM events) SELECT outcome, count(*) AS n, count(DISTINCT event_type) AS n_labels, round(avg(value), 6) AS mean, round(max(value), 6) AS best FROM x GROUP BY 1")
def proposal_selection(spark, d):
    x = table(spark, d, "events").withColumn("outcome", F.when(F.col("value") > 30, "selected").when(F.col("value") > 10, "rejected").otherwise("skipped"))
    return x.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_labels"), R(F.avg("value")).alias("mean"), R(F.max("value")).alias("best"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS n_error FROM events WHERE user_id % 10 <> 3 GROUP BY 1 HAVING count(*) >= 5")
def heuristic_cohort(spark, d):
    """Per-member figures of a cohort without its excluded members."""
    e = table(spark, d, "events").where("user_id % 10 <> 3")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_error")).where("n >= 5")


_SIGNATURES = [("kg m^2 s^-1", "M1L2T-1"), ("J K^-1", "M1L2T-2K-1"), ("mol^-1", "N-1"), ("Hz V^-1", "M-1L-2T2I1"), ("furlong", None), (" ", None), ("m.s^-1", "L1T-1")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({u!r}, {'NULL' if c is None else repr(c)})" for u, c in _SIGNATURES) + ") t(unit, signature)")
def unit_text_signature(spark, d):
    """Signatures of compound unit texts; null where a symbol is unknown."""
    return spark.createDataFrame([(u,) for u, _ in _SIGNATURES], "unit string").select("unit", units.to_compact(units.infer_signature(F.col("unit"))).alias("signature"))


_VECTORS = [("A0E0L1I0M1H0T-2D0", "M1L1T-2"), ("A1E0L0I0M0H0T0D0", "N1"), ("A0E1L0I0M0H-1T0D0", "I1K-1"), ("A0E0L0I0M0H0T0D1", ""), ("A0E0L0pt5I0M0H0T0D0", "L0.5")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({u!r}, {c!r})" for u, c in _VECTORS) + ") t(vector, signature)")
def dimension_vectors(spark, d):
    return spark.createDataFrame([(u,) for u, _ in _VECTORS], "vector string").select("vector", units.to_compact(units.parse_dimension_vector(F.col("vector"))).alias("signature"))


@query("SELECT evidence_id, stream_id, kind FROM (SELECT evidence_id, unnest(json_extract(payload, '$.canonical_runtime_context.streams[*]')) AS s, json_extract_string(s, '$.stream_id') AS stream_id, json_extract_string(s, '$.data_kind') AS kind FROM (SELECT DISTINCT evidence_id, payload FROM runtime_evidence WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')) WHERE stream_id IS NOT NULL")
def json_bindings(spark, d):
    """Bindings in nested JSON as rows, read in the engine as variants."""
    t = table(spark, d, "runtime_evidence").select("evidence_id", "payload").distinct()
    s = t.select("evidence_id", F.explode(F.expr("try_variant_get(try_parse_json(payload), '$.canonical_runtime_context.streams', 'array<variant>')")).alias("s"))
    return s.select("evidence_id", F.expr("try_variant_get(s, '$.stream_id', 'string')").alias("stream_id"), F.expr("try_variant_get(s, '$.data_kind', 'string')").alias("kind")).where("stream_id IS NOT NULL")


@query(f"WITH v AS (SELECT DISTINCT hp_id, {_ID('atom_id')} AS atom_id, name FROM hyperparams), a AS (SELECT DISTINCT {_ID('atom_id')} AS atom_id FROM atoms) SELECT DISTINCT hp_id, name, CASE WHEN v.atom_id IS NULL OR v.atom_id = '' THEN 'no expression' WHEN a.atom_id IS NULL THEN 'unknown expression' END AS problem FROM v LEFT JOIN a ON a.atom_id = v.atom_id")
def manifest_variables(spark, d):
    """Variables resolved to their expressions, with what is wrong."""
    v = table(spark, d, "hyperparams").select("hp_id", norm_id(F.col("atom_id")).alias("atom_id"), "name", F.col("atom_id").isNull().alias("_n")).distinct()
    a = table(spark, d, "atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), F.lit(True).alias("_in")).where("atom_id IS NOT NULL").distinct()
    return v.join(a, "atom_id", "left").select("hp_id", "name", F.when(F.col("atom_id").isNull(), "no expression").when(F.col("_in").isNull(), "unknown expression").alias("problem")).distinct()


@query("SELECT s_suppkey, CASE WHEN abs(h1 * (h1 * b + h2 * d) - h2 * (h1 * a + h2 * c)) > 1e-9 THEN 2 WHEN h1 <> 0 OR h2 <> 0 THEN 1 ELSE 0 END AS rank, abs(h1 * (h1 * b + h2 * d) - h2 * (h1 * a + h2 * c)) > 1e-9 AS observable FROM (SELECT s_suppkey, s_suppkey % 3 AS a, s_suppkey % 5 AS b, s_nationkey % 2 AS c, s_nationkey % 3 AS d, s_suppkey % 2 AS h1, s_nationkey % 4 AS h2 FROM supplier)")
def diag_sequential_filter_check_observability(spark, d):
    from tessera.operators import signals

    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.array(k % 3, k % 5, n % 2, n % 3).cast("array<double>").alias("f"), F.array(k % 2, n % 4).cast("array<double>").alias("h"))
    return signals.observability(s, "s_suppkey", "f", "h", 2)


@query()
def fit_sinh_rise(spark, d):
    from tessera.operators import signals

    return signals.fit_segments(_diag_base(spark, d).select("g", "pos", "x"), "g", "pos", "x", model="sinh")


@query()
def fit_sinh_fall(spark, d):
    from tessera.operators import signals

    return signals.fit_segments(_diag_base(spark, d).select("g", "pos", "x"), "g", "pos", "x", rising=False, model="sinh")


@query("WITH x AS (SELECT DISTINCT p_brand AS family, CASE WHEN p_size > 25 THEN 'wide' ELSE 'narrow' END AS technique, p_retailprice AS cost FROM part), s AS (SELECT family, technique, cost, 0.35 * CASE WHEN family = 'Brand#13' THEN 1 ELSE 0 END + 0.35 * CASE WHEN technique = 'wide' THEN 1 ELSE 0.5 END AS s FROM x) SELECT family, technique, round(cost, 2) AS cost, CAST(round(s, 6) AS DOUBLE) AS score FROM s WHERE s >= 0.1 ORDER BY s DESC, cost, family, technique LIMIT 20")
def operation_retrieval(spark, d):
    """The twenty best operations by family and technique; the cheaper first on ties."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.when(F.col("p_size") > 25, "wide").otherwise("narrow").alias("technique"), F.col("p_retailprice").alias("cost")).distinct()
    s = 0.35 * (F.col("family") == "Brand#13").cast("double") + 0.35 * F.when(F.col("technique") == "wide", 1.0).otherwise(0.5)
    return p.withColumn("s", s).where("s >= 0.1").orderBy(F.col("s").desc(), "cost", "family", "technique").limit(20).select("family", "technique", F.round("cost", 2).alias("cost"), R("s").alias("score"))


@query("WITH h AS (SELECT user_id, event_type, count(*) FILTER (gain > 0) AS n FROM (SELECT user_id, event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gain FROM events) GROUP BY 1, 2) SELECT user_id, event_type, round(CASE WHEN n >= 2 THEN least(0.1 * n, 0.5) ELSE 0 END, 6)::DOUBLE AS bonus FROM h")
def heuristic_bonus(spark, d):
    """A prior from repeated positive outcomes of the same kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("value") - F.lag("value").over(w)).alias("gain"))
    n = e.groupBy("user_id", "event_type").agg(F.count(F.when(F.col("gain") > 0, 1)).alias("n"))
    return n.select("user_id", "event_type", R(F.when(F.col("n") >= 2, F.least(0.1 * F.col("n"), F.lit(0.5))).otherwise(0.0)).alias("bonus"))


@query("SELECT e.key AS stage, count(*) AS n_runs FROM (SELECT DISTINCT run_id, stages FROM pipeline_runs WHERE json_valid(stages) AND json_type(stages) = 'OBJECT') r, json_each(r.stages) e GROUP BY 1")
def stages_of_runs(spark, d):
    """How many states of runs name a stage."""
    r = table(spark, d, "pipeline_runs").select("run_id", "stages").distinct()
    return r.select(F.explode(F.json_object_keys("stages")).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n_runs"))
