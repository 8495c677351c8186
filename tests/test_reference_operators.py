"""Relational, series, retrieval, graph, signal, source and stream operators on small tables and their edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import units
from tessera.functions.diagnostics import BY_KEY, DIAGNOSTICS, diagnose
from tessera.operators import catalog, fitting, graphs, matching, relational, retrieval, series, signals
from tessera.operators.components import components
from tessera.sources import files
from tessera.streaming import logs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)


# --- relational


def test_latest_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), (None, 3, "n")], "k string, t int, v string")
    assert rows(relational.best_row(df, ["k"], ["t", "v"], ["v", "t"])) == [("a", "y", 1), (None, "n", 3)]
    assert relational.best_row(df.limit(0), ["k"], ["t"], ["v"]).count() == 0


def test_lateral_and_stale(spark):
    left = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", None, 1)], "k string, v int, r int")
    assert rows(relational.lateral_top1(left.select("k"), right, "k", ["r", "v"], ["v"])) == [("a", 2), ("b", None), ("c", None)]
    derived = spark.createDataFrame([("a", 9), ("b", None)], "k string, v int")
    assert rows(relational.missing_or_stale(left, derived, "k", ["v"]), "k", "reason") == [("a", "stale"), ("c", "missing")]


def test_upsert_ties_go_to_changes(spark):
    a = spark.createDataFrame([("k", 1, "old"), ("m", 1, "old")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 1, "new"), ("n", 1, "new")], "k string, t int, v string")
    assert rows(relational.upsert(a, b, "k", "t"), "k", "v") == [("k", "new"), ("m", "old"), ("n", "new")]


def test_pareto_front(spark):
    r = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 20, (300, 2)))] + [(900, None, 5.0)]
    df = spark.createDataFrame(pts, "id int, a double, b double")
    low = lambda v: -math.inf if v is None else v
    want = {i for i, a, b in pts if not any(low(x) >= low(a) and low(y) >= low(b) and (low(x) > low(a) or low(y) > low(b)) for _, x, y in pts)}
    assert {x.id for x in relational.pareto_front(df, "id", "a", "b").collect()} == want


def test_h_index_and_split(spark):
    df = spark.createDataFrame([("a", v) for v in (9, 7, 3, 3, 1)] + [("b", 0)], "k string, v int")
    assert rows(relational.h_index(df, "k", "v")) == [("a", 3), ("b", 0)]
    import hashlib

    got = spark.createDataFrame([(str(i),) for i in range(50)], "k string").select("k", relational.hash_split(F.col("k"), F.lit("b")).alias("p")).collect()
    assert all(r.p == int(hashlib.sha256(f"b:{r.k}".encode()).hexdigest(), 16) % 5 for r in got)


def test_as_of_and_range_join(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 0.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 4.0, 40), ("a", 9.0, 90)], "k string, t double, v int")
    assert rows(relational.as_of_join(left, right, "k", "t", "t", "v")) == [("a", 0.0, None), ("a", 1.0, 10), ("a", 5.0, 40), ("b", 1.0, None)]
    rng = spark.createDataFrame([(0.0, 2.0, "x"), (1.5, 30.0, "y"), (3.0, 3.0, "empty")], "a double, b double, n string")
    pts = spark.createDataFrame([(v,) for v in (0.0, 1.9, 2.0, 29.9, 30.0, 3.0)], "p double")
    got = rows(relational.range_join(pts, rng, "p", "a", "b", 2.0), "p", "n")
    assert got == [(0.0, "x"), (1.9, "x"), (1.9, "y"), (2.0, "y"), (29.9, "y"), (3.0, "y")]


# --- series


def seq(spark, values, key="s"):
    return spark.createDataFrame([(key, i, float(v) if v is not None else None) for i, v in enumerate(values)], "k string, i int, v double")


def test_runs_and_intervals(spark):
    df = seq(spark, [1, 1, 0, 1, 0, 1, 1, 1])
    assert rows(series.runs(df, "k", "i", F.col("v") > 0)) == [("s", 1, 0, 1, 2), ("s", 2, 3, 3, 1), ("s", 3, 5, 7, 3)]
    assert rows(series.runs(df, "k", "i", F.col("v") > 0, 2)) == [("s", 1, 0, 1, 2), ("s", 2, 5, 7, 3)]
    iv = spark.createDataFrame([("s", 0.0, 2.0), ("s", 2.0, 3.0), ("s", 5.0, 6.0), ("s", 5.5, 5.7), ("s", 9.0, 8.0)], "k string, a double, b double")
    assert rows(series.merge_intervals(iv, "k", "a", "b")) == [("s", 0.0, 3.0), ("s", 5.0, 6.0)]
    assert series.runs(df.limit(0), "k", "i", F.col("v") > 0).count() == 0


def test_moving_windows(spark):
    v = [5, 1, 9, 2, 7, 7]
    df = seq(spark, v)
    avg = [r.smooth for r in series.moving_average(df, "k", "i", "v", 3).orderBy("i").collect()]
    assert np.allclose(avg, np.convolve(v, np.ones(3) / 3, "same"))
    pad = np.pad(v, 1, "edge")
    med = [r.median for r in series.moving_median(df, "k", "i", "v", 1).orderBy("i").collect()]
    assert med == [sorted(pad[i : i + 3])[1] for i in range(6)]
    assert rows(series.hop_windows(df, "k", "i", "v", 4, 2), "window", "mean") == [(0, 4.25), (1, 6.25)]
    assert series.hop_windows(df, "k", "i", "v", 40, 2).count() == 0


def test_jumps_quality_and_masks(spark):
    df = seq(spark, [0, 1, 0, 1, 101, 100, 101, 100])
    smooth = [r.smooth for r in series.remove_jumps(df, "k", "i", "v").orderBy("i").collect()]
    assert max(smooth) < 50
    flat = seq(spark, [1.0] * 10)
    assert [r.good for r in series.quality_blocks(flat, "k", "i", "v", 8).orderBy("block").collect()] == [False, True]
    reg = spark.createDataFrame([("s", 1.0, 3.0), ("s", 2.0, 4.0)], "k string, a double, b double")
    assert rows(series.mask(df, reg, "k", "i", "a", "b"), "i") == [(1,), (2,), (3,)]
    assert rows(series.mask(df, reg, "k", "i", "a", "b", exclude=True), "i") == [(0,), (4,), (5,), (6,), (7,)]


def test_resample(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 2.0, 4.0), ("s", 3.0, 0.0)], "k string, t double, v double")
    got = {r.t: r.v for r in series.resample(df, "k", "t", "v", 0.5).collect()}
    assert got == {t: float(np.interp(t, [0, 2, 3], [0, 4, 0])) for t in np.arange(0, 3.01, 0.5)}
    near = {r.t: r.v for r in series.resample(df, "k", "t", "v", 1.0, "nearest").collect()}
    assert near == {0.0: 0.0, 1.0: 4.0, 2.0: 4.0, 3.0: 0.0}


# --- retrieval


def test_fts_edges(spark):
    df = spark.createDataFrame([(1, "Kalman filter"), (2, "filter"), (3, None), (4, ""), (5, "other")], "id int, t string")
    got = dict(rows(retrieval.fts(df, "id", "t", "kalman FILTER")))
    assert set(got) == {1, 2} and got[1] == pytest.approx(math.log(5) + math.log(5 / 2) + 1) and got[2] == pytest.approx(math.log(5 / 2))
    assert retrieval.fts(df, "id", "t", "  ").count() == 0
    assert retrieval.fts(df, "id", "t", "absent").count() == 0


def test_vector_top_k(spark):
    r = np.random.default_rng(0)
    vs = r.normal(size=(5000, 8))
    vs[7] = vs[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)] + [(9000, None), (9001, [1.0])], "id int, e array<double>")
    got: dict = {}
    for x in retrieval.vector_top_k(df, df.where("id % 100 = 0"), "id", "e", 5, 8).collect():
        got.setdefault(x.query, {})[x.rank] = x.key
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    for q in range(0, 5000, 100):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        assert [got[q][i] for i in range(1, 6)] == list(np.lexsort((np.arange(len(s)), -s))[:5])


def test_vector_at_least_takes_all_queries(spark):
    vs = np.random.default_rng(1).normal(size=(5000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)] + [(9000, None), (9100, [1.0])], "id int, e array<double>")
    got = {(x.query, x.key) for x in retrieval.vector_at_least(df, df.where("id % 100 = 0"), "id", "e", 0.8, 8).collect()}
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    want = {(q, int(k)) for q in range(0, 5000, 100) for k in np.nonzero(u @ u[q] >= 0.8)[0] if k != q}
    assert got == want and len({q for q, _ in got}) > 1


def test_rank_fusion_and_recall(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    got = dict(rows(retrieval.rrf([(a, 1.0), (b, 2.0)], "k")))
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 2 / 61)}
    hits = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank int")
    truth = spark.createDataFrame([(1, "y"), (2, "x")], "q int, k string")
    assert rows(retrieval.recall_and_mrr(hits, truth, "q", "k")) == [(0.5, 0.25)]


# --- graphs


def test_graph_operators(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "b"), (None, "q")], "s string, d string")
    assert rows(graphs.topo_levels(e, "s", "d")) == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None), ("z", None)]
    assert ("x", "x") in rows(graphs.closure(e, "s", "d")) and ("a", "c") in rows(graphs.closure(e, "s", "d"))
    assert rows(graphs.has_cycle(e, "s", "d")) == [(6, 3, False)]
    assert rows(components(e, "s", "d")) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x")]
    assert components(e.limit(0), "s", "d").count() == 0


def test_long_and_wide_components(spark):
    chain = [(f"{i:04}", f"{i + 1:04}") for i in range(400)]
    star = [("hub", f"leaf{i}") for i in range(500)]
    got = dict(rows(components(spark.createDataFrame(chain + star, "a string, b string"), "a", "b")))
    assert {got[f"{i:04}"] for i in range(401)} == {"0000"} and {got[f"leaf{i}"] for i in range(500)} == {"hub"}


# --- catalog and fitting


def test_tiers_and_expectations(spark):
    left = spark.createDataFrame([("a.X",), ("a.x ",), ("q.z",), ("none",), (None,)], "k string")
    right = spark.createDataFrame([("a.X",), ("b.z",), ("c.z",)], "t string")
    low = lambda c: F.lower(F.trim(c))
    got = rows(catalog.tiered_match(left, right, "k", "t", [lambda c: c, low, lambda c: F.regexp_replace(low(c), r"^.*\.", "")]))
    assert got == [("a.X", 0, "a.X", 1), ("a.x ", 1, "a.X", 1), ("none", None, None, 0), ("q.z", 2, None, 2)]
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 2), ("b", None, 2)], "id string, lo int, hi int")
    assert rows(catalog.expectations(df, "id", {"ordered": F.col("lo") <= F.col("hi")})) == [("duplicate", 1), ("ordered", 1)]


def test_json_members(spark):
    texts = ['{"a": 1, "b": 2}', "[1, 2, 3]", '["a"]', '[{"fqdn": "a"}]', "7", "null", "", None, '{"cut']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [tuple(r) for r in df.select(catalog.json_members(F.col("j")), catalog.json_contains(F.col("j"), "a")).collect()]
    assert [g[0] for g in got] == [2, 3, 1, 1, 0, 0, 0, 0, 0] and [g[1] for g in got] == [True, False, True, True] + [False] * 5


def test_fitting(spark):
    r = np.random.default_rng(4)
    p, v = r.uniform(1, 9, 500), r.uniform(1, 9, 500)
    df = spark.createDataFrame([(float(a), float(b), float(a * b**2)) for a, b in zip(p, v)], "p double, v double, c double")
    assert np.allclose(fitting.power_law_exponents(df, ["p", "v", "c"]), np.array([-0.5, -1, 0.5]) * -1) or np.allclose(fitting.power_law_exponents(df, ["p", "v", "c"]), [0.5, 1, -0.5])
    assert rows(fitting.direct_residual(df, "c", "p * v * v"))[0][1] == pytest.approx(0)
    assert rows(fitting.direct_residual(df.limit(5), "c", "p"))[0][1] is None
    m = np.log(np.stack([p, v, p * v**2]))
    c = np.corrcoef(m)
    assert rows(fitting.participation_ratio(df, ["p", "v", "c"], log=True))[0][0] == pytest.approx(9 / (c**2).sum())
    g = df.select(F.lit("g").alias("g"), "p", (2 + 3 * F.col("p")).alias("y"))
    fit = fitting.ransac_line(g, "g", "p", "y").first()
    assert fit.a == pytest.approx(2) and fit.b == pytest.approx(3) and fit.residual < 1e-9


def test_exact_median(spark):
    r = np.random.default_rng(5)
    cases = [[], [2.5], [1.0, 3.0], [0.0] * 500 + [1.0] * 500, [0.0] * 999 + [7.0], [math.nan] * 7 + [1.0], [math.inf] * 3 + [1.0, 2.0], [*(10.0 ** r.uniform(-300, 0, 4001))], [*r.uniform(0, 1e-12, 2500), *r.uniform(1, 1 + 1e-9, 2500)]]
    for x in cases:
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        for accuracy in (10_000, 20):  # bounds close around the middle, and far
            n, median = fitting.exact_median(df, "x", accuracy).first()
            assert n == len(x) and (median == pytest.approx(float(np.median(x)), rel=1e-12, abs=0, nan_ok=True) if x else median is None)


def test_direct_residual_holds_no_map_of_all_values(spark):
    df = spark.range(3000).select((F.col("id") + 1.0).alias("a"), (F.rand(1) + F.col("id")).alias("b"))
    d = fitting.direct_residual(df, "a", "b")
    assert "percentile(" not in d._jdf.queryExecution().optimizedPlan().toString()  # it keeps each distinct value in one task
    p = df.toPandas()
    assert rows(d) == [(3000, pytest.approx(((p.a - p.b).abs() / p.max(axis=1)).median()))]


def most_rows(df):
    """The most rows that a step of the plan gave when df was collected."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().length())]
    return most


def test_top_matches_of_a_word_that_all_share(spark):
    n = 1500
    nodes = spark.range(n).select(F.format_string("n%04d", "id").alias("node_id"), F.expr("array('hot', 'x' || id % 7)").alias("words"), F.expr("array('x')").alias("ports"), F.lit("c").alias("category"), (F.col("id") % 3).alias("n_in"), F.lit(1).alias("n_out"))
    nodes = nodes.unionByName(nodes.limit(1).select(F.lit("p0900").alias("node_id"), "words", "ports", "category", F.lit(1).alias("n_in"), "n_out"))  # a primitive's name
    prims = spark.range(n).select(F.format_string("p%04d", "id").alias("name"), F.expr("array('hot', 'own' || id, CASE WHEN id < 20 THEN 'x' || id % 3 END)").alias("words"), F.expr("array('x')").alias("ports"), F.lit("c").alias("category"), F.lit(1).alias("required"), F.lit(2).alias("total"), F.lit(1).alias("outs"))
    df = matching.top_matches(nodes, prims, 2)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.node_id, -r.score, r.name)):
        got.setdefault(r.node_id, []).append((r.name, round(r.score, 6)))
    flat, rare = 2.0 + 1.5 + 0.75, [math.log(n / c) for c in (7, 7, 6)]
    for i in range(n):
        t, x = flat + (1.5 if i % 3 else -0.25), i % 7
        best = [(f"p{j:04d}", round(t + rare[x], 6)) for j in (x, x + 3)] if x < 3 else [("p0000", round(t, 6)), ("p0001", round(t, 6))]
        assert got[f"n{i:04d}"] == best
    assert got["p0900"][0] == ("p0900", round(flat + 1.5 + 20, 6)) and len(got) == n + 1
    assert most_rows(df) < 10 * n  # all pairs are n * n


# --- diagnostics


def test_empty_groups_have_their_constants(spark):
    base = spark.createDataFrame([], "g int, pos bigint, x double, y double, z double, i bigint, j bigint, b boolean, k string")
    groups = spark.createDataFrame([(1,)], "g int")
    for d in DIAGNOSTICS[::6]:
        r = diagnose(base, d, groups).first()
        assert (r.metric, r.flag) == (float(d.empty[0]), d.empty[1]), d.key


def test_diagnostics_by_hand(spark):
    x = [3.0, 1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([(1, i, v, v, v, i % 2, i % 2, True, "a") for i, v in enumerate(x)], "g int, pos bigint, x double, y double, z double, i bigint, j bigint, b boolean, k string")
    m = lambda key: diagnose(df, BY_KEY[key]).first().metric
    assert m("diag_searching_validate_sorted_order") == 1
    assert m("diag_greedy_detect_criterion_ties") == 2
    mad = np.median(np.abs(np.array(x) - 2))
    assert m("diag_signal_detect_measure_estimate_snr") == pytest.approx(10 * math.log10(np.mean(np.square(x)) / (1.4826 * mad) ** 2))
    assert m("diag_ode_solver_check_energy_conservation") == 2.0
    assert m("diag_compression_validate_lossless_roundtrip") == 0


# --- signals and units


def test_band_pass():
    fs = 200.0
    t = np.arange(2000) / fs
    sos = signals.butter_sos(4, 3, 25, fs)
    mid = signals.zero_phase(sos, np.sin(2 * np.pi * 10 * t))[500:1500]
    low = signals.zero_phase(sos, np.sin(2 * np.pi * 0.3 * t))[500:1500]
    high = signals.zero_phase(sos, np.sin(2 * np.pi * 80 * t))[500:1500]
    assert np.allclose(mid, np.sin(2 * np.pi * 10 * t)[500:1500], atol=0.01) and np.abs(low).max() < 0.01 and np.abs(high).max() < 0.01


def test_event_rate_from_signal(spark):
    fs, n = 50.0, 1000
    x = np.zeros(n)
    x[25::50] = 1
    x = np.convolve(x, np.hanning(9), "same")
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i bigint, v double")
    got = signals.event_rate_from_signal(df, "k", "i", "v", fs).collect()
    assert len(got) > 15 and np.median([r.rate for r in got]) == pytest.approx(60.0)


def test_chain_diagnostics(spark):
    r = np.random.default_rng(5)
    data = [("good", c, i, float(v)) for c in range(4) for i, v in enumerate(r.normal(size=200))] + [("bad", c, i, float(v + 3 * c)) for c in range(4) for i, v in enumerate(r.normal(size=200))]
    got = {x.k: x for x in signals.chain_diagnostics(spark.createDataFrame(data, "k string, c int, i int, v double"), "k", "c", "i", "v").collect()}
    assert got["good"].rhat < 1.02 and got["good"].ess > 400 and got["bad"].rhat > 1.5


def test_units(spark):
    df = spark.createDataFrame([("Newton", "M1L1T-2"), ("mean_power", "M1L2T-3"), (" m/s^2 ", "L1T-2"), ("ratio", "")], "u string, c string")
    for r in df.select("u", "c", units.to_compact(units.parse_units(F.col("u"))).alias("got"), units.compatible(units.parse_units(F.col("u")), units.from_compact(F.col("c"))).alias("ok")).collect():
        assert r.ok and r.got == r.c
    v = spark.createDataFrame([("A0E0L2I0M1H0T-3D0",)], "v string").select(units.to_compact(units.parse_dimension_vector(F.col("v"))).alias("c")).first()
    assert v.c == "M1L2T-3"


# --- sources


def test_files(spark, tmp_path):
    (tmp_path / "g.gr").write_text("c note\np sp 3 2\na 1 2 5\na 2 3 1.5\nbroken\n")
    assert rows(files.read_dimacs(spark, str(tmp_path / "g.gr"))) == [(0, 1, 5.0), (1, 2, 1.5)]
    v = np.array([1, -1, 2047, -2048, 0, 5, 100, -100])
    u = v & 0xFFF
    raw = bytearray()
    for a, b in u.reshape(-1, 2):
        raw += bytes([a & 0xFF, (a >> 8) | ((b >> 8) << 4), b & 0xFF])
    (tmp_path / "s.dat").write_bytes(bytes(raw))
    got = files.read_212(spark, str(tmp_path / "s.dat")).orderBy("pos", "channel").collect()
    assert [r.value for r in got] == list(map(float, v))
    df = spark.createDataFrame([(1, "a", "general"), (2, None, "internal")], "id int, v string, tier string")
    files.write_tiers(df, "tier", ["general", "internal"], str(tmp_path / "t"))
    assert files.read(spark, str(tmp_path / "t/general.parquet")).count() == 1 and files.read(spark, str(tmp_path / "t/internal.parquet")).count() == 2
    h = files.content_hash(df, ["id", "v"]).first()
    assert h == files.content_hash(df.orderBy(F.desc("id")), ["id", "v"]).first() and h.n_rows == 2
    assert h.hash != files.content_hash(df.withColumn("v", F.lit("x")), ["id", "v"]).first().hash
    df.write.option("header", "true").csv(str(tmp_path / "c.csv"))
    assert rows(files.read(spark, str(tmp_path / "c.csv"), schema="id int, v string, tier string")) == rows(df)


def test_edf(spark, tmp_path):
    fields = [("EEG", 16), ("", 80), ("uV", 8), ("-100", 8), ("100", 8), ("-1000", 8), ("1000", 8), ("", 80), ("4", 8), ("", 32)]
    head = "0".ljust(8) + "".ljust(80) * 2 + "01.01.2401.01.01" + str(256 + 256).ljust(8) + "".ljust(44) + "2".ljust(8) + "1".ljust(8) + "1".ljust(4)
    body = "".join(v.ljust(w) for v, w in fields)
    data = np.array([0, 100, -100, 1000, 10, 20, 30, 40], "<i2").tobytes()
    (tmp_path / "x.edf").write_bytes((head + body).encode() + data)
    got = files.read_edf(spark, str(tmp_path / "x.edf"), 0.25, 1.0).orderBy("pos").collect()
    assert [(r.channel, r.pos, r.value) for r in got] == [("EEG", i, pytest.approx(x)) for i, x in [(1, 10.0), (2, -10.0), (3, 100.0), (4, 1.0)]]


def test_clocked_tsv(spark, tmp_path):
    (tmp_path / "e.txt").write_bytes("skipped line\nTime\tHR\n1/2/2024 00:30:05 PM\t61\nbad\t1\n1/2/2024 1:00:00 PM\t62\n".encode("utf-16"))
    got = files.read_clocked_tsv(spark, str(tmp_path / "e.txt"), 1, "Time", "America/New_York").orderBy("at").collect()
    assert [(r.HR, r["at"]) for r in got] == [("61", dt.datetime(2024, 1, 2, 17, 30, 5)), ("62", dt.datetime(2024, 1, 2, 18, 0))]


def test_slices(spark):
    df = spark.createDataFrame([("s", i) for i in range(6)], "k string, i int")
    for text in ("1:4", "::2", "-3:", ":-1", "2", "-1", "1::3"):
        want = list(range(6))[slice(*[int(p) if p else None for p in text.split(":")])] if ":" in text else [list(range(6))[int(text)]]
        assert [r.i for r in files.array_slice(df, "k", "i", text).orderBy("i").collect()] == want


# --- streams


def test_upsert_stream_can_run_again(spark, tmp_path):
    src, sink = tmp_path / "in", f"file://{tmp_path}/out"
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t int, v string")
    two = spark.createDataFrame([("a", 2, "y"), ("b", 0, "late"), ("c", 1, "z")], "k string, t int, v string")
    write = logs.upsert_sink(sink, "k", "t")
    one.write.mode("append").parquet(str(src))
    run = lambda: spark.readStream.schema(one.schema).parquet(str(src)).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    two.write.mode("append").parquet(str(src))
    run()
    want = [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "z")]
    assert rows(logs.latest_state(spark, sink, "k", "t"), "k", "t", "v") == want
    write(two, 1)  # the last batch, run again after a failure
    assert rows(logs.latest_state(spark, sink, "k", "t"), "k", "t", "v") == want


def test_upsert_stream_merges_its_changes(spark, tmp_path):
    sink = f"file://{tmp_path}/out"
    write = logs.upsert_sink(sink, "k", "t")
    want: dict = {}
    for epoch in range(logs.MERGE + 3):
        batch = [(f"k{(epoch * i) % 11}", epoch - i, f"v{epoch}-{i}") for i in range(4)]
        for k, t, v in batch:
            want[k] = max(want.get(k, (t, v)), (t, v))
        write(spark.createDataFrame(batch, "k string, t int, v string"), epoch)
    assert {(k, t, v) for k, t, v in rows(logs.latest_state(spark, sink, "k", "t"), "k", "t", "v")} == {(k, *x) for k, x in want.items()}
    assert len(list(tmp_path.glob("out/s=*"))) == 1


def test_dispatch_latency(spark):
    df = spark.createDataFrame([("d1", "start", 1.0, "p", None), ("d1", "finish", 3.0, "p", True), ("d1", "finish", 9.0, "p", False), ("d2", "start", 1.0, "p", None), ("d3", "finish", 1.0, "p", True)], "d string, kind string, t double, g string, ok boolean")
    assert rows(logs.dispatch_latency(df, "d", "kind", "t", "g", "ok")) == [("p", 2, 1, 0, 2.0, 2.0)]


def test_alphabet_counts_all_characters(spark):
    texts = [("fr", "déjà vu, ça va"), ("fr", "œuf\n\té"), ("ja", "波形を見る"), ("ja", "abc 😀𠮷"), ("xx", "e\u0301 é"), ("xx", ""), ("xx", None), ("none", None)]
    want: dict = {}
    for lang, text in texts:
        want.setdefault(lang, set()).update(text or "")
    got = {r.lang: (r.symbols, r.shared) for r in catalog.alphabet(spark.createDataFrame(texts, "lang string, text string"), "lang", "text", ["a", "b", "波"]).collect()}
    assert got == {k: (len(v), len(v & {"a", "b", "波"})) for k, v in want.items() if v}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_topo_levels_of_random_graphs(spark, seed):
    import random

    r = random.Random(seed)
    e = {(a, b) for b in range(1, 80) for a in r.sample(range(b), min(b, r.choice([1, 1, 1, 1, 2, 3]))) if r.random() > 0.05}
    e |= {(i, i + 1) for i in range(100, 160)} | {(130, 300), (5, 300), (200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (7, 204), (204, 205), (400, 400), (400, 401)}
    nodes = {x for y in e for x in y}
    before = {n: [a for a, b in e if b == n] for n in nodes}
    level: dict = {}
    while more := [n for n in nodes if n not in level and all(a in level for a in before[n])]:
        for n in more:
            level[n] = max((level[a] + 1 for a in before[n]), default=0)
    df = spark.createDataFrame([*e, *list(e)[:9], (None, 1), (3, None)], "s int, d int")
    assert {x.node: x.level for x in graphs.topo_levels(df, "s", "d").collect()} == {n: level.get(n) for n in nodes}
