"""The queries of the general training-data operators (p1, p2, p3, p5, p6, p7), and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import norm_id, norm_name, trim_all
from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators.nested import shred, shred_typed, subtype_table, variants
from tessera.operators.ordinals import compare
from tessera.operators.packed_fields import choose_dialects, split_packed
from tessera.operators.reconcile import diff_copies
from tessera.operators.references import Child, Parent, orphan_counts, orphan_rows
from tessera.operators.snapshots import snapshot_changes
from tessera.sources.tables import table


def _blank(c: Column) -> Column:
    return F.coalesce(trim_all(c), F.lit(""))


# --- 1: several values packed in one field


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    atoms = table(spark, d, "atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), "domain_tags").where(F.col("atom_id").isNotNull())
    return split_packed(atoms, ["atom_id"], "domain_tags").select("atom_id", "pos", F.col("value").alias("tag"))


def p1_dialects(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct fields each dialect won, and the values it gave."""
    return choose_dialects(table(spark, d, "atoms"), "domain_tags").groupBy("dialect").agg(F.count(F.lit(1)).alias("n_fields"), F.sum(F.size("vals")).alias("n_values"))


# --- 2: nested records


def _latest_runs(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("last_update_at", "stages", "metadata")).alias("_l")
    return table(spark, d, "pipeline_runs").where(F.col("run_id").isNotNull()).groupBy("run_id").agg(last).select("run_id", "_l.stages", "_l.metadata")


#: Subtypes of the objects that the nested columns hold.
EVIDENCE = {"heuristic": {"supported_action_classes": None}, "entry": {"heuristic": "heuristic"}, "payload": {"heuristics": "entry"}}
STREAM = {"stream": {"stream_id": None}}
STAGES = {"stage": {"name": None}}
PORT = {"port": {"name": None}}


def _row(source: str, record: str, child: str, parent_pos: Column, pos: Column, item: Column) -> list[Column]:
    return [F.lit(source).alias("source_table"), F.col(record).alias("record_id"), F.lit(child).alias("child"), parent_pos.alias("parent_pos"), pos.alias("pos"), item.alias("item")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(-1).cast("bigint")
    # the classes of the heuristics in the entries of the payloads; a single one in place of a list is a list of one
    route = "/payload.heuristics/entry.heuristic/heuristic.supported_action_classes"
    at = lambda i: F.greatest(F.col("places")[i], F.lit(0)).cast("bigint")
    ev = shred(table(spark, d, "runtime_evidence"), ["evidence_id"], "payload", ("heuristics",), EVIDENCE, (route,), scalars=True)
    actions = ev.where(F.col("value").isNotNull()).select(*_row("runtime_evidence", "evidence_id", "action_class", at(0), at(2), F.col("value")))
    ports = shred_typed(table(spark, d, "cdg_nodes"), ["node_id"], "inputs", PORT).where("subtype = 'port'")
    inputs = ports.select(*_row("cdg_nodes", "node_id", "input", none, F.col("pos").cast("bigint"), F.col("_e.name")))
    runs = _latest_runs(spark, d)
    # stages by name: the members of the top object, or the names of the stages in the top list
    st = shred(runs, ["run_id"], "stages", rules=STAGES)
    by_key = st.where("level = 1 and key is not null").select("run_id", F.col("key").alias("name"))
    by_name = st.where("level = 2 and owner = 'stage' and key = 'name' and value is not null and places[0] >= 0").select("run_id", F.col("value").alias("name"))
    stages = by_key.unionByName(by_name).select(*_row("pipeline_runs", "run_id", "stage", none, none, F.col("name")))
    md = shred(runs, ["run_id"], "metadata", scalars=True).where("level > 0")
    metadata = md.select(*_row("pipeline_runs", "run_id", "metadata", none, none, F.col("path")))
    return actions.unionByName(inputs).unionByName(stages).unionByName(metadata).where(F.col("record_id").isNotNull()).distinct()


def p2_cdg_ports(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of all ports, with the link to their node."""
    parts = [
        shred_typed(table(spark, d, "cdg_nodes"), ["node_id"], side, {})
        .select("node_id", F.lit(side).alias("side"), F.col("pos").cast("bigint").alias("pos"), "_e.name", "_e.type_desc", "_e.constraints", "_e.data_kind", "_e.required", "_e.default_value_repr")
        for side in ("inputs", "outputs")
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p2_streams(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the streams inside evidence payloads."""
    ev = table(spark, d, "runtime_evidence").select("evidence_id", "payload").distinct()
    nodes = shred(ev, ["evidence_id"], "payload", ("canonical_runtime_context",), STREAM)
    return subtype_table(nodes, ["evidence_id"], "stream", {"stream_id": "string", "data_kind": "string", "sampling_rate": "double"}).where(F.col("stream_id").isNotNull()).withColumn("pos", F.col("pos").cast("bigint")).drop("state")


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    """The object variants of evidence payloads: state, subtype, count, an example's path."""
    return variants(shred(table(spark, d, "runtime_evidence"), ["evidence_id"], "payload", rules=EVIDENCE))


# --- 3: two copies

FIELDS3 = ["fqdn", "content_hash", "semver", "status", "visibility_tier", "is_publishable"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    low = lambda c: F.lower(_blank(F.col(c)))
    yes = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit(""))
    atoms = table(spark, d, "atoms").select(
        norm_id(F.col("atom_id")).alias("atom_id"), F.struct("loaded_at", _blank(F.col("fqdn")).alias("fqdn"), low("status").alias("status"), low("visibility_tier").alias("visibility_tier"), yes("is_publishable").alias("is_publishable")).alias("a"), F.lit(None).alias("v"), F.lit(None).alias("m")
    )
    versions = table(spark, d, "atom_versions").where("is_latest").select(
        norm_id(F.col("atom_id")).alias("atom_id"), F.lit(None).alias("a"), F.struct("created_at", low("content_hash").alias("content_hash"), _blank(F.col("semver")).alias("semver")).alias("v"), F.lit(None).alias("m")
    )
    manifest = table(spark, d, "manifest_atoms").select(
        norm_id(F.col("atom_id")).alias("atom_id"), F.lit(None).alias("a"), F.lit(None).alias("v"),
        F.struct(_blank(F.col("fqdn")).alias("fqdn"), low("content_hash").alias("content_hash"), _blank(F.col("semver")).alias("semver"), low("status").alias("status"), low("visibility_tier").alias("visibility_tier"), yes("is_publishable").alias("is_publishable")).alias("m"),
    )
    # the catalog's record is spread over two tables; one grouping by key joins them and the manifest's copy
    joined = atoms.unionByName(versions).unionByName(manifest).where(F.col("atom_id").isNotNull()).groupBy("atom_id").agg(F.max("a").alias("a"), F.max("v").alias("v"), F.max("m").alias("m"))
    cat = F.when(F.col("a").isNotNull(), F.struct(F.lit(True).alias("_in"), F.col("a.fqdn").alias("fqdn"), F.coalesce("v.content_hash", F.lit("")).alias("content_hash"), F.coalesce("v.semver", F.lit("")).alias("semver"), F.col("a.status").alias("status"), F.col("a.visibility_tier").alias("visibility_tier"), F.col("a.is_publishable").alias("is_publishable")))
    man = F.when(F.col("m").isNotNull(), F.struct(F.lit(True).alias("_in"), *[F.col(f"m.{f}").alias(f) for f in FIELDS3]))
    out = compare(joined.select("atom_id", cat.alias("_c0"), man.alias("_c1")), "atom_id", [(0, 1)], FIELDS3)
    kind = F.when(F.col("change") == "only_old", "missing_in_manifest").when(F.col("change") == "only_new", "missing_in_catalog").otherwise("differs")
    return out.select(F.col("key").alias("atom_id"), kind.alias("kind"), "field")


def p3_manifest_vs_last_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The general operator on two plain tables: the manifest against the last snapshot's delivery."""
    pick = lambda df: df.select(norm_id(F.col("atom_id")).alias("atom_id"), _blank(F.col("fqdn")).alias("fqdn"), F.lower(_blank(F.col("status"))).alias("status"))
    snaps = table(spark, d, "atom_snapshots")
    last = snaps.agg(F.max(F.struct("snapshot_date", "delivered_at")).alias("_l")).select("_l.*")
    return diff_copies(pick(table(spark, d, "manifest_atoms")), pick(snaps.join(F.broadcast(last), ["snapshot_date", "delivered_at"], "left_semi")), "atom_id", ["fqdn", "status"])


# --- 5: snapshots


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    low = lambda c: F.lower(trim_all(F.col(c))).alias(c)
    snaps = table(spark, d, "atom_snapshots").select("snapshot_date", "delivered_at", norm_id(F.col("atom_id")).alias("atom_id"), trim_all(F.col("fqdn")).alias("fqdn"), low("status"), low("visibility_tier"))
    out = snapshot_changes(snaps, "snapshot_date", "delivered_at", "atom_id", ["fqdn", "status", "visibility_tier"])
    return out.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "atom_id", "change", "field")


# --- 6: references


def _references(spark: SparkSession, d: str) -> tuple[list[Child], list[Parent]]:
    t = {n: table(spark, d, n) for n in ("atoms", "atom_snapshots", "atom_versions", "io_specs", "hyperparams", "benchmarks")}
    by_id = [Child(n, t[n], norm_id(F.col(k)), norm_id(F.col("atom_id")), F.col("loaded_at"), "atom_id") for n, k in (("atom_versions", "version_id"), ("io_specs", "io_spec_id"), ("hyperparams", "hp_id"))]
    by_name = Child("benchmarks", t["benchmarks"], norm_id(F.col("benchmark_id")), norm_name(F.col("atom_fqdn")), F.col("loaded_at"), "fqdn")
    parents = []
    for name, col, norm in (("atom_id", "atom_id", norm_id), ("fqdn", "fqdn", norm_name)):
        parents.append(Parent(name, t["atoms"], norm(F.col(col)), F.col("loaded_at")))
        parents.append(Parent(name, t["atom_snapshots"], norm(F.col(col)), gone=True))
    return [*by_id, by_name], parents


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(*_references(spark, d)).select("src_table", "row_key", "kind", F.date_format("loaded", "yyyy-MM").alias("period"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by table, kind and month."""
    return orphan_counts(*_references(spark, d))


# --- 7: hierarchies


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "cdg_nodes").select("node_id", norm_name(F.col("parent_id")).alias("parent_id")), "node_id", "parent_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    h = _hierarchy(spark, d)
    return h.select(
        "node_id",
        F.coalesce("root", F.lit("")).alias("root_id"),
        F.when(F.col("state") == "tree", F.col("depth")).when(F.col("state") == "below", -2).otherwise(-1).cast("bigint").alias("depth"),
        F.coalesce(F.col("size") - 1, F.lit(-1)).cast("bigint").alias("n_descendants"),
        F.coalesce("path", F.lit("")).alias("path"),
    )


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node of a tree with all nodes below it and how far down they are."""
    return descendants(_hierarchy(spark, d), "node_id").withColumnsRenamed({"ancestor": "node_id", "node": "descendant_id"})


QUERIES = {f.__name__: f for f in (p1_found, p1_dialects, p2_found, p2_cdg_ports, p2_streams, p2_variants, p3_found, p3_manifest_vs_last_snapshot, p5_found, p6_found, p6_report, p7_found, p7_descendants)}

_T = lambda c: rf"regexp_replace({c}, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')"
_N = lambda c: f"nullif(lower({_T(c)}), '')"

_P6 = f"""
WITH refs AS (
  SELECT 'atom_versions' src_table, 'id' p, {_N('version_id')} row_key, {_N('atom_id')} k, loaded_at FROM atom_versions
  UNION ALL SELECT 'io_specs', 'id', {_N('io_spec_id')}, {_N('atom_id')}, loaded_at FROM io_specs
  UNION ALL SELECT 'hyperparams', 'id', {_N('hp_id')}, {_N('atom_id')}, loaded_at FROM hyperparams
  UNION ALL SELECT 'benchmarks', 'fqdn', {_N('benchmark_id')}, nullif({_T('atom_fqdn')}, ''), loaded_at FROM benchmarks),
 r AS (SELECT src_table, p, row_key, k, min(loaded_at) l FROM refs WHERE k IS NOT NULL AND row_key IS NOT NULL GROUP BY ALL),
 here AS (SELECT 'id' p, {_N('atom_id')} k, min(loaded_at) since FROM atoms GROUP BY ALL
  UNION ALL SELECT 'fqdn', nullif({_T('fqdn')}, ''), min(loaded_at) FROM atoms GROUP BY ALL),
 gone AS (SELECT DISTINCT 'id' p, {_N('atom_id')} k FROM atom_snapshots UNION ALL SELECT DISTINCT 'fqdn', nullif({_T('fqdn')}, '') FROM atom_snapshots),
 found AS (SELECT src_table, row_key, CASE WHEN h.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'removed' ELSE 'missing' END kind, strftime(l, '%Y-%m') period
  FROM r LEFT JOIN here h ON h.p = r.p AND h.k = r.k LEFT JOIN gone g ON g.p = r.p AND g.k = r.k WHERE h.k IS NULL OR l < h.since)
"""

SQL = {
    "p2_cdg_ports": """
SELECT DISTINCT node_id, side, pos, e.name AS name, e.type_desc AS type_desc, e.constraints AS constraints, e.data_kind AS data_kind, e.required AS required, e.default_value_repr AS default_value_repr
FROM (SELECT node_id, 'inputs' AS side, unnest(inputs) AS e, CAST(unnest(range(len(inputs))) AS BIGINT) AS pos FROM cdg_nodes
      UNION ALL SELECT node_id, 'outputs', unnest(outputs), CAST(unnest(range(len(outputs))) AS BIGINT) FROM cdg_nodes) WHERE e IS NOT NULL""",
    "p3_found": f"""
WITH a AS (SELECT {_N('atom_id')} atom_id, arg_max(struct_pack(fqdn := coalesce({_T('fqdn')}, ''), status := lower(coalesce({_T('status')}, '')), visibility_tier := lower(coalesce({_T('visibility_tier')}, '')), is_publishable := coalesce(CAST(CAST(is_publishable AS INT) AS VARCHAR), '')), loaded_at) r FROM atoms GROUP BY 1),
 v AS (SELECT {_N('atom_id')} atom_id, arg_max(struct_pack(h := lower(coalesce({_T('content_hash')}, '')), s := coalesce({_T('semver')}, '')), created_at) r FROM atom_versions WHERE is_latest GROUP BY 1),
 c AS (SELECT a.atom_id, a.r.fqdn, coalesce(v.r.h, '') content_hash, coalesce(v.r.s, '') semver, a.r.status, a.r.visibility_tier, a.r.is_publishable FROM a LEFT JOIN v USING (atom_id) WHERE a.atom_id IS NOT NULL),
 m AS (SELECT DISTINCT {_N('atom_id')} atom_id, coalesce({_T('fqdn')}, '') fqdn, lower(coalesce({_T('content_hash')}, '')) content_hash, coalesce({_T('semver')}, '') semver, lower(coalesce({_T('status')}, '')) status, lower(coalesce({_T('visibility_tier')}, '')) visibility_tier, coalesce(CAST(is_publishable AS VARCHAR), '') is_publishable FROM manifest_atoms WHERE {_N('atom_id')} IS NOT NULL)
SELECT atom_id, 'missing_in_manifest' AS kind, '' AS field FROM c ANTI JOIN m USING (atom_id)
UNION ALL SELECT atom_id, 'missing_in_catalog', '' FROM m ANTI JOIN c USING (atom_id)
""" + "".join(f"UNION ALL SELECT c.atom_id, 'differs', '{f}' FROM c JOIN m USING (atom_id) WHERE c.{f} <> m.{f}\n" for f in FIELDS3),
    "p3_manifest_vs_last_snapshot": f"""
WITH s AS (SELECT {_N('atom_id')} atom_id, max(struct_pack(f := coalesce({_T('fqdn')}, ''), s := lower(coalesce({_T('status')}, '')))) r FROM atom_snapshots WHERE (snapshot_date, delivered_at) = (SELECT (snapshot_date, delivered_at) FROM atom_snapshots ORDER BY snapshot_date DESC, delivered_at DESC LIMIT 1) GROUP BY 1),
 m AS (SELECT {_N('atom_id')} atom_id, max(struct_pack(f := coalesce({_T('fqdn')}, ''), s := lower(coalesce({_T('status')}, '')))) r FROM manifest_atoms GROUP BY 1),
 j AS (SELECT coalesce(m.atom_id, s.atom_id) atom_id, m.r mr, s.r sr FROM m FULL JOIN s ON m.atom_id = s.atom_id)
SELECT atom_id, CASE WHEN sr IS NULL THEN 'missing_in_right' ELSE 'missing_in_left' END AS kind, '' AS field FROM j WHERE atom_id IS NOT NULL AND (mr IS NULL OR sr IS NULL)
UNION ALL SELECT atom_id, 'differs', 'fqdn' FROM j WHERE mr.f <> sr.f UNION ALL SELECT atom_id, 'differs', 'status' FROM j WHERE mr.s <> sr.s""",
    "p5_found": f"""
WITH d AS (SELECT snapshot_date d, max(delivered_at) a FROM atom_snapshots GROUP BY 1),
 o AS (SELECT d, a, lag(d) OVER (ORDER BY d) AS before FROM d),
 s AS (SELECT DISTINCT snapshot_date d, {_N('atom_id')} atom_id, {_T('fqdn')} fqdn, lower({_T('status')}) status, lower({_T('visibility_tier')}) tier FROM atom_snapshots t JOIN d ON t.snapshot_date = d.d AND t.delivered_at = d.a WHERE {_N('atom_id')} IS NOT NULL),
 n AS (SELECT s.*, o.before FROM s JOIN o USING (d) WHERE o.before IS NOT NULL)
SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, atom_id, 'added' AS change, '' AS field FROM n WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.d = n.before AND b.atom_id = n.atom_id)
UNION ALL SELECT strftime(o.d, '%Y-%m-%d'), b.atom_id, 'removed', '' FROM s b JOIN o ON b.d = o.before WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.d = o.d AND x.atom_id = b.atom_id)
UNION ALL SELECT strftime(n.d, '%Y-%m-%d'), n.atom_id, 'changed', 'fqdn' FROM n JOIN s b ON b.d = n.before AND b.atom_id = n.atom_id WHERE b.fqdn IS DISTINCT FROM n.fqdn
UNION ALL SELECT strftime(n.d, '%Y-%m-%d'), n.atom_id, 'changed', 'status' FROM n JOIN s b ON b.d = n.before AND b.atom_id = n.atom_id WHERE b.status IS DISTINCT FROM n.status
UNION ALL SELECT strftime(n.d, '%Y-%m-%d'), n.atom_id, 'changed', 'visibility_tier' FROM n JOIN s b ON b.d = n.before AND b.atom_id = n.atom_id WHERE b.tier IS DISTINCT FROM n.tier""",
    "p6_found": _P6 + "SELECT src_table, row_key, kind, period FROM found",
    "p6_report": _P6 + "SELECT src_table, kind, period, count(*) AS n FROM found GROUP BY ALL",
    "p7_found": f"""
WITH RECURSIVE n AS (SELECT DISTINCT node_id, nullif({_T('parent_id')}, '') parent_id FROM cdg_nodes),
 e AS (SELECT n.node_id, p.node_id AS parent_id FROM n LEFT JOIN n p ON p.node_id = n.parent_id),
 t AS (SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM e WHERE parent_id IS NULL
       UNION ALL SELECT e.node_id, t.root_id, t.depth + 1, t.path || '/' || e.node_id FROM e JOIN t ON e.parent_id = t.node_id),
 up AS (SELECT node_id AS origin, parent_id AS top FROM e WHERE parent_id IS NOT NULL
        UNION SELECT up.origin, e.parent_id FROM up JOIN e ON e.node_id = up.top WHERE e.parent_id IS NOT NULL),
 ring AS (SELECT DISTINCT origin AS node_id FROM up WHERE origin = top),
 below AS (SELECT top AS node_id, count(*) AS n FROM up GROUP BY 1)
SELECT e.node_id, coalesce(t.root_id, '') AS root_id,
  CAST(CASE WHEN t.node_id IS NOT NULL THEN t.depth WHEN ring.node_id IS NOT NULL THEN -1 ELSE -2 END AS BIGINT) AS depth,
  CAST(CASE WHEN ring.node_id IS NOT NULL THEN -1 ELSE coalesce(below.n, 0) END AS BIGINT) AS n_descendants, coalesce(t.path, '') AS path
FROM e LEFT JOIN t USING (node_id) LEFT JOIN ring USING (node_id) LEFT JOIN below USING (node_id)""",
    "p7_descendants": f"""
WITH RECURSIVE n AS (SELECT DISTINCT node_id, nullif({_T('parent_id')}, '') parent_id FROM cdg_nodes),
 e AS (SELECT n.node_id, p.node_id AS parent_id FROM n LEFT JOIN n p ON p.node_id = n.parent_id),
 t AS (SELECT node_id, [node_id] AS way FROM e WHERE parent_id IS NULL
       UNION ALL SELECT e.node_id, list_append(t.way, e.node_id) FROM e JOIN t ON e.parent_id = t.node_id)
SELECT way[i] AS node_id, t.node_id AS descendant_id, CAST(len(way) - i AS BIGINT) AS distance FROM t, range(1, len(way)) r(i)""",
}
