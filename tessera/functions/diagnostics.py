"""Numeric diagnostics: a metric and a flag for each group of an ordered series.

A diagnostic is a short chain of steps over a long table (g, pos and value columns): window steps add columns in
series order, group steps reduce to finer groups first, filters drop rows, and the last step aggregates to one metric
a group. All of it is built-in expressions, so it stays inside generated code and needs one shuffle by group; groups
are combined before it where the diagnostic has no window.

Input columns: x and y (paired values), z (signed), i and j (small integer labels), b (boolean), k (a kind), pos.
Populations are whole: deviations divide by n unless said otherwise. A group without rows has the diagnostic's empty
metric and flag, where the caller names the groups (`diagnose(..., groups=)`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Step:
    kind: str  # 'window', 'group' or 'filter'
    cols: dict[str, str] = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    test: str = ""


def window(**cols: str) -> Step:
    """Columns over the series; OVER w is in order of pos, OVER wx in order of x, OVER wg the whole group."""
    return Step("window", cols)


def group(*keys: str, **cols: str) -> Step:
    """One row for each group and keys."""
    return Step("group", cols, keys)


def keep(test: str) -> Step:
    return Step("filter", test=test)


@dataclass
class Diagnostic:
    family: str
    name: str
    metric: str
    flag: str
    empty: tuple[float, bool | None]
    steps: list[Step] = field(default_factory=list)
    #: Values that stand as {name} in the expressions, with their defaults.
    params: dict[str, float] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"diag_{self.family}_{self.name}"


_W = {"w": "(PARTITION BY g ORDER BY pos)", "wx": "(PARTITION BY g ORDER BY x, pos)", "wg": "(PARTITION BY g)", "wd": "(PARTITION BY g ORDER BY pos DESC)"}


def _render(text: str, params: dict) -> str:
    text = re.sub(r"OVER (wx|wg|wd|w)\b", lambda m: f"OVER {_W[m[1]]}", text)
    for k, v in params.items():
        text = text.replace(f"{{{k}}}", repr(v))
    return text.replace("PCT(", "percentile(").replace("INF", "double('infinity')")


def diagnose(df: DataFrame, d: Diagnostic, groups: DataFrame | None = None, **params: float) -> DataFrame:
    """(g, metric, flag) of each group; groups (column g) adds those without rows, params replace the diagnostic's defaults."""
    if unknown := set(params) - set(d.params):
        raise ValueError(f"{d.key} has no parameter {', '.join(sorted(unknown))}")
    put = lambda text: F.expr(_render(text, d.params | params))
    for s in d.steps:
        if s.kind == "window":
            df = df.withColumns({a: put(e) for a, e in s.cols.items()})
        elif s.kind == "group":
            df = df.groupBy("g", *s.keys).agg(*[put(e).alias(a) for a, e in s.cols.items()])
        else:
            df = df.where(put(s.test))
    out = df.groupBy("g").agg(put(d.metric).cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    if groups is not None:
        out = groups.select("g").distinct().join(out, "g", "left")
    empty = F.lit(float(d.empty[0]))
    return out.select("g", F.coalesce("m", empty).alias("metric"), F.when(F.col("m").isNull(), F.lit(d.empty[1]).cast("boolean")).otherwise(put(d.flag).cast("boolean")).alias("flag"))


def _share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1 ELSE 0 END)"


def _count(test: str) -> str:
    return f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"


_INF = float("inf")
_DIFF = window(d="x - lag(x) OVER w")
_ABS_DIFF = window(d="abs(x - lag(x) OVER w)")
_NORMS = group("i", n="sqrt(sum(x * x))")
_NONE = "NULL"

DIAGNOSTICS = [
    Diagnostic("baseline_analysis", "check_onset_coverage", "CAST(count(x) AS DOUBLE) / {signal_length}", "m >= 1e-4", (0.0, False), params={"signal_length": 1000}),
    Diagnostic("baseline_analysis", "detect_padding_saturation", "CAST(greatest(count(*) - {original_length}, 0) AS DOUBLE) / count(*)", "m > 0.5", (0.0, False), params={"original_length": 50}),
    Diagnostic("baseline_analysis", "monitor_normalization_clipping", _share("abs(x - 1) <= 1.001e-5"), "m > 0.1", (0.0, False)),
    Diagnostic("baseline_analysis", "validate_component_balance", "CASE WHEN count(*) <= 1 OR max(t) = 0 THEN 1.0 ELSE -sum(CASE WHEN e > 0 THEN e / t * log2(e / t) ELSE 0 END) / log2(count(*)) END", "m >= 0.5", (1.0, True), [group("k", e="sum(x * x)"), window(t="sum(e) OVER wg")]),
    Diagnostic("belief_propagation", "monitor_message_convergence", "max_by(x, pos)", "m < 1e-6", (0.0, True)),
    Diagnostic("belief_propagation", "validate_belief_normalization", "max(abs(s - 1))", "m < 1e-8", (0.0, True), [group("i", s="sum(x)")]),
    Diagnostic("belief_propagation", "analyze_message_damping", _share("d * p < 0"), "m > 0.1", (0.0, False), [_DIFF, window(p="lag(d) OVER w"), keep("d IS NOT NULL AND p IS NOT NULL")]),
    Diagnostic("clustering", "analyze_cluster_balance", "CAST(max(n) AS DOUBLE) / min(n)", "m <= 10", (1.0, True), [group("i", n="count(*)"), keep("n > 0")]),
    Diagnostic("clustering", "monitor_assignment_stability", _share("i <> j"), "m <= 0.01", (0.0, True)),
    Diagnostic("clustering", "detect_empty_clusters", _count("i = 0"), "m > 0", (0.0, False)),
    Diagnostic("clustering", "validate_separation", "CASE WHEN avg(y) = 0 THEN INF ELSE avg(x) / nullif(avg(y), 0) END", "m >= 1", (1.0, True)),
    Diagnostic("combinatorics", "analyze_branching_factor", "avg(i)", "m <= 10", (0.0, True)),
    Diagnostic("combinatorics", "monitor_bound_tightness", "max_by((x - y) / greatest(abs(x), 1.0), pos)", "m <= 0.5", (0.0, True)),
    Diagnostic("combinatorics", "detect_symmetry", _share("b"), "m > 0.3", (0.0, False)),
    Diagnostic("combinatorics", "check_pruning_effectiveness", _share("k = 'view'"), "m >= 0.1", (0.0, False)),
    Diagnostic("compression", "analyze_compression_ratio", "greatest(greatest(sum(y), 0.0) / greatest(sum(x), 1.0) - {entropy_bound}, 0)", "m <= 0.2", (0.0, True), params={"entropy_bound": 0.5}),
    Diagnostic("compression", "validate_lossless_roundtrip", _share("i <> j"), "m = 0", (0.0, True)),
    Diagnostic("compression", "detect_dictionary_bloat", "CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(max_by(x, pos), 0.0) / greatest(min_by(x, pos), 1.0) END", "m <= 2", (1.0, True)),
    Diagnostic("compression", "monitor_encoding_throughput", "CASE WHEN sum(y) <= 0 THEN INF ELSE sum(x) / nullif(sum(y), 0) END", "m >= 1000", (_INF, True)),
    Diagnostic("dimensionality_reduction", "analyze_explained_variance", "sum(abs(x)) / nullif(sum(abs(x)), 0)", "m >= 0.95", (0.0, False)),
    Diagnostic("dimensionality_reduction", "detect_crowding", "greatest(0.0, 1 - CAST(sum((pos - r) * (pos - r)) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE) * (count(*) * count(*) - 1) / 3, 0))", "m >= 0.9", (1.0, True), [window(r="row_number() OVER wx - 1")]),
    Diagnostic("dimensionality_reduction", "check_reconstruction_error", "sqrt(sum((x - y) * (x - y))) / nullif(sqrt(sum(x * x)), 0)", "m <= 0.1", (0.0, True)),
    Diagnostic("divide_and_conquer", "measure_split_balance", "avg(least(x, y) / nullif(greatest(x, y), 0))", _NONE, (1.0, None)),
    Diagnostic("divide_and_conquer", "check_recursion_depth", "CASE WHEN count(*) <= 1 THEN 0.0 ELSE max(i) / (2 * log2(count(*))) END", "m > 1", (0.0, False)),
    Diagnostic("divide_and_conquer", "profile_merge_cost", "avg(x / nullif(x + y, 0))", _NONE, (0.0, None)),
    Diagnostic("divide_and_conquer", "detect_subproblem_overlap", "CAST(count(i) - count(DISTINCT i) AS DOUBLE) / count(*)", _NONE, (0.0, None)),
    Diagnostic("dynamic_programming", "detect_table_sparsity", _share("i <> 0"), _NONE, (0.0, None)),
    Diagnostic("dynamic_programming", "compress_dp_table", "CASE WHEN count(*) <= {reuse_distance} THEN 0.0 ELSE 1 - CAST({reuse_distance} AS DOUBLE) / count(*) END", _NONE, (0.0, None), params={"reuse_distance": 10}),
    Diagnostic("dynamic_programming", "validate_subproblem_overlap", "avg(CASE WHEN i > 0 THEN i END)", "m > 1.5", (0.0, False)),
    Diagnostic("geometry", "detect_duplicate_points", _count("p IS NOT NULL AND sqrt((x - p) * (x - p) + (y - q) * (y - q)) < 0.05"), "m > 0", (0.0, False), [window(p="lag(x) OVER (PARTITION BY g ORDER BY x, y, pos)", q="lag(y) OVER (PARTITION BY g ORDER BY x, y, pos)")]),
    # turns are taken around the whole outline and held against the first one's sign
    Diagnostic("geometry", "validate_convexity", "CASE WHEN count(*) < 3 THEN 0 WHEN min_by(c, CASE WHEN c <> 0 THEN pos END) > 0 THEN " + _count("c < 0") + " ELSE " + _count("c > 0") + " END", "m = 0", (0.0, True),
        [window(x0="first_value(x) OVER w", y0="first_value(y) OVER w", x1="lead(x) OVER w", y1="lead(y) OVER w"), window(x1="coalesce(x1, x0)", y1="coalesce(y1, y0)"),
         window(x2="coalesce(lead(x1) OVER w, max_by(x1, -pos) OVER wg)", y2="coalesce(lead(y1) OVER w, max_by(y1, -pos) OVER wg)"), window(c="((x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1))")]),
    Diagnostic("graph_optimization", "detect_negative_weights", _count("z < 0"), "m > 0", (0.0, False)),
    Diagnostic("graph_optimization", "monitor_relaxation_convergence", "coalesce(min(CASE WHEN same THEN step END), -1)", "m >= 0", (-1.0, False),
        [window(step="CAST(floor(pos / 10) AS INT)", dim="pos % 10"), window(p="lag(x) OVER (PARTITION BY g, dim ORDER BY step)"), group("step", same="bool_and(coalesce(abs(x - p) <= 1e-8 + 1e-5 * abs(p), FALSE))")]),
    Diagnostic("graph_optimization", "detect_distance_overflow", _count("x > {threshold}"), "m > 0", (0.0, False), params={"threshold": 400}),
    Diagnostic("graph_optimization", "analyze_graph_density", "CASE WHEN count(DISTINCT i) <= 1 THEN 0.0 ELSE CAST(count(*) AS DOUBLE) / (count(DISTINCT i) * (count(DISTINCT i) - 1)) END", "m > 0.5", (0.0, False)),
    Diagnostic("graph_signal_processing", "analyze_spectral_gap", "max(CASE WHEN r = 2 THEN x END)", "m > 0.01", (0.0, False), [window(r="row_number() OVER wx")]),
    Diagnostic("graph_signal_processing", "validate_filter_response", "max(abs(x))", "m < 100", (0.0, True)),
    Diagnostic("graph_traversal", "detect_frontier_overflow", "max(x) / ceil(sqrt(count(*)))", "m > 1", (0.0, False)),
    Diagnostic("greedy", "detect_criterion_ties", "sum(CASE WHEN c > 1 THEN c ELSE 0 END)", "m > 0", (0.0, False),
        [window(e="CASE WHEN x - lag(x) OVER wx <= 1e-8 THEN 0 ELSE 1 END"), window(t="sum(e) OVER (PARTITION BY g ORDER BY x, pos ROWS UNBOUNDED PRECEDING)"), group("t", c="count(*)")]),
    Diagnostic("greedy", "estimate_solution_quality", "least(greatest(sum(x) / nullif(sum(x + y), 0), 0.0), 1.0)", "m >= 0.99", (0.0, False)),
    Diagnostic("greedy", "detect_redundant_feasibility", _share("b"), "m = 1", (1.0, True)),
    Diagnostic("information_theory", "check_distribution_support", _share("z <= 0"), "m = 0", (0.0, True)),
    Diagnostic("information_theory", "analyze_sample_sufficiency", "CAST(count(*) AS DOUBLE) / count(DISTINCT i)", "m >= 5", (0.0, False)),
    Diagnostic("information_theory", "detect_numerical_underflow", _share("-5 * x < -700"), "m <= 0.05", (0.0, True)),
    Diagnostic("information_theory", "validate_information_inequality", "max(greatest(x - y, 0.0))", "m <= 1e-9", (0.0, True)),
    Diagnostic("kalman_filter", "check_innovation_consistency", "avg(z * z / (y * 50 + 1))", "m >= 0.5 AND m <= 2", (0.0, True)),
    Diagnostic("kalman_filter", "analyze_kalman_gain_magnitude", "max(n)", "m < 100", (0.0, True), [_NORMS]),
    Diagnostic("kalman_filter", "check_state_smoothness", _count("d > 5 * h"), _NONE, (0.0, None), [_ABS_DIFF, keep("d IS NOT NULL"), window(h="PCT(d, 0.5) OVER wg")]),
    Diagnostic("linear_algebra", "validate_decomposition_accuracy", "sqrt(sum((x - y) * (x - y))) / nullif(sqrt(sum(x * x)), 0)", "m <= 1e-8", (0.0, True)),
    Diagnostic("linear_algebra", "detect_rank_deficiency", _count("abs(x) > 1e-10 * t"), "m >= {expected_rank}", (0.0, False), [window(t="max(abs(x)) OVER wg")], {"expected_rank": 10}),
    Diagnostic("linear_algebra", "monitor_iterative_convergence", "exp(avg(ln(x / p)))", "m < 0.99", (0.0, True), [window(p="lag(x) OVER w"), keep("p > 0 AND x > 0")]),
    Diagnostic("mcmc", "detect_divergent_transitions", _count("abs(x - y) > {threshold}"), "m > 0", (0.0, False), params={"threshold": 100}),
    Diagnostic("mcmc", "estimate_mass_matrix", "CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(var_samp(x), 1e-3) END", _NONE, (1.0, None)),
    Diagnostic("neural_network", "detect_gradient_explosion", "max(n)", "m > 100", (0.0, False), [_NORMS]),
    Diagnostic("neural_network", "analyze_activation_statistics", _share("i = 0"), "m > 0.5", (0.0, False)),
    Diagnostic("neural_network", "monitor_loss_convergence", "max_by(abs(x - p) / nullif(abs(p), 0), pos)", "m < 1e-6", (1.0, False), [window(p="lag(x) OVER w"), keep("p IS NOT NULL")]),
    Diagnostic("neural_network", "check_weight_distribution", "CASE WHEN min(n) = 0 THEN INF ELSE max(n) / nullif(min(n), 0) END", "m <= 100", (1.0, True), [_NORMS]),
    Diagnostic("number_theory", "validate_input_range", _count("abs(x) > 65.536"), "m = 0", (0.0, True)),
    Diagnostic("number_theory", "monitor_gcd_convergence", "avg(x / p)", _NONE, (0.0, None), [window(p="lag(x) OVER w"), keep("p <> 0")]),
    Diagnostic("ode_solver", "monitor_step_rejection_rate", "1 - " + _share("b"), "m <= 0.5", (0.0, True)),
    Diagnostic("ode_solver", "detect_stiffness", "max(abs(x)) / nullif(min(abs(x)), 0)", "m > 1e6", (1.0, False), [keep("x <> 0")]),
    Diagnostic("ode_solver", "check_energy_conservation", "max(abs(x - f))", "m <= 1e-6", (0.0, True), [window(f="first_value(x) OVER w")]),
    Diagnostic("ode_solver", "validate_order_of_accuracy", "regr_slope(ln(x), ln(y))", "m >= 1.6", (0.0, True), [keep("x > 0 AND y > 0")]),
    Diagnostic("optimization", "detect_vanishing_gradient", "min(n)", "m < 1e-15", (0.0, False), [_NORMS]),
    Diagnostic("optimization", "analyze_loss_landscape", "CASE WHEN min(abs(x)) = 0 THEN INF ELSE max(abs(x)) / nullif(min(abs(x)), 0) END", "m > 1e10", (1.0, False)),
    Diagnostic("optimization", "check_constraint_violation", "max(greatest({low} - x, x - {high}, 0.0))", "m <= 0", (0.0, True), params={"low": 5, "high": 100}),
    Diagnostic("optimization", "monitor_convergence_rate", "greatest(-avg(ln(d / p)), 0.0)", "m >= 0.5", (1.0, True), [_ABS_DIFF, window(p="lag(d) OVER w"), keep("d > 0 AND p > 0")]),
    Diagnostic("particle_filter", "monitor_effective_sample_size", "sum(exp(x - t)) * sum(exp(x - t)) / sum(exp(2 * (x - t))) / count(*)", "m > 0.5", (0.0, False), [window(t="max(x) OVER wg")]),
    Diagnostic("particle_filter", "track_weight_variance", "regr_slope(v, i)", "m <= 0", (0.0, True), [group("i", v="var_pop(x)")]),
    Diagnostic("particle_filter", "check_resampling_quality", "CAST(max(n) AS DOUBLE) / sum(n)", "m < 0.1", (0.0, True), [group("i", n="count(*)")]),
    Diagnostic("quadrature", "analyze_integrand_smoothness", "max(abs(x - p) / nullif(abs(y - q), 0))", "m <= 1e6", (0.0, True), [window(p="lag(x) OVER w", q="lag(y) OVER w")]),
    Diagnostic("quadrature", "detect_singularity", "max(abs(x))", "m <= 1e10", (0.0, True)),
    Diagnostic("quadrature", "monitor_convergence_rate", "avg(d / p)", "m < 0.5", (0.0, True), [_ABS_DIFF, window(p="lag(d) OVER w"), keep("p > 0")]),
    Diagnostic("quadrature", "check_domain_coverage", "greatest(max(d), {high} - max(x)) / ({high} - {low})", "m <= 0.1 + 1e-12", (0.0, True), [window(d="x - lag(x, 1, CAST({low} AS DOUBLE)) OVER wx")], {"low": 0, "high": 500}),
    Diagnostic("randomized", "validate_hash_independence", "CAST(sum(i) AS DOUBLE) / nullif(sum(j), 0)", "m <= 2", (0.0, True)),
    Diagnostic("randomized", "analyze_sketch_accuracy", "avg(abs(y - x) / greatest(abs(x), 1e-12))", "m <= 0.1", (0.0, True)),
    Diagnostic("randomized", "monitor_sample_coverage", "CAST(count(DISTINCT i) AS DOUBLE) / {population_size}", "m >= 0.1", (0.0, False), params={"population_size": 13}),
    Diagnostic("randomized", "check_concentration_bound", _share("x > {bound}"), "m <= 0.05", (0.0, True), params={"bound": 100}),
    Diagnostic("searching", "validate_sorted_order", _count("x > n"), "m = 0", (0.0, True), [window(n="lead(x) OVER w")]),
    Diagnostic("searching", "analyze_distribution_uniformity", "CASE WHEN count(*) <= 2 THEN 1.0 ELSE greatest(0.0, 1 - stddev_pop(CASE WHEN d > 0 THEN d END) / avg(CASE WHEN d > 0 THEN d END) / 2) END", "m > 0.7 AND n > 2", (0.0, False), [_DIFF]),
    Diagnostic("searching", "analyze_iteration_count", "CASE WHEN count(*) <= 1 THEN 0.0 ELSE max(pos) / (2 * log2(count(*))) END", "m > 1", (0.0, False)),
    Diagnostic("sequential_filter", "validate_innovation_whiteness", "CASE WHEN count(*) >= 12 AND avg(c * c) >= 1e-15 THEN greatest(" + ", ".join(f"abs(sum(c * p{k}) / (count(*) - {k}))" for k in range(1, 11)) + ") / avg(c * c) END", "m < 1.96 / sqrt(n)", (0.0, True),
        [window(c="x - avg(x) OVER wg"), window(**{f"p{k}": f"lag(c, {k}) OVER w" for k in range(1, 11)})]),
    Diagnostic("signal_detect_measure", "estimate_snr", "CASE WHEN count(*) < 2 THEN NULL WHEN max(mad) = 0 THEN INF ELSE 10 * log10(greatest(avg(x * x) / nullif(pow(1.4826 * max(mad), 2), 0), 1e-30)) END", "m > 10", (0.0, False), [window(h="PCT(x, 0.5) OVER wg"), window(v="abs(x - h)"), window(mad="PCT(v, 0.5) OVER wg")]),
    Diagnostic("signal_detect_measure", "analyze_peak_threshold_sensitivity", _share("abs(x - {threshold}) <= 0.1 * {threshold}"), "m < 0.2", (0.0, True), params={"threshold": 20}),
    Diagnostic("signal_detect_measure", "check_event_rate_stationarity", "sqrt(greatest(sum(CAST(c AS DOUBLE) * c) / 10 - (sum(c) / CAST(10 AS DOUBLE)) * (sum(c) / CAST(10 AS DOUBLE)), 0.0)) / (sum(c) / CAST(10 AS DOUBLE))", "m < 0.5", (0.0, True),
        [window(lo="min(x) OVER wg", hi="max(x) OVER wg"), keep("hi > lo"), window(bin="least(CAST(floor((x - lo) / (hi - lo) * 10) AS INT), 9)"), group("bin", c="count(*)")]),
    Diagnostic("signal_detect_measure", "estimate_false_positive_rate", _share("x < {threshold} + 2 * {noise_std}"), "m < 0.05", (0.0, True), params={"threshold": 20, "noise_std": 5}),
    Diagnostic("signal_filter", "analyze_pole_stability", "max(sqrt(x * x + y * y))", "m < 1", (0.0, True)),
    Diagnostic("signal_filter", "measure_passband_ripple", "max(x) - min(x)", "m < 1", (0.0, True), [keep("b")]),
    Diagnostic("signal_filter", "analyze_group_delay_variation", "CASE WHEN count(*) < 2 THEN 0.0 ELSE max(y) - min(y) END", "m < 1", (0.0, True)),
    Diagnostic("signal_filter", "detect_transient_response", "sum(CASE WHEN pos < {n_transient_samples} THEN x * x ELSE 0 END) / nullif(sum(x * x), 0)", _NONE, (0.0, None), params={"n_transient_samples": 10}),
    Diagnostic("signal_transform", "analyze_window_leakage", "least(greatest(1 - sum(y * y) / nullif(sum(x * x), 0), 0.0), 1.0)", "m > 0.5", (0.0, False)),
    Diagnostic("signal_transform", "detect_spectral_aliasing", "sum(CASE WHEN pos >= floor(0.9 * t) THEN x * x ELSE 0 END) / nullif(sum(x * x), 0)", "m > 0.1", (0.0, False), [window(t="count(*) OVER wg")]),
    Diagnostic("signal_transform", "validate_parseval_energy", "abs(sum(x * x) - sum(y * y) / count(*)) / nullif(greatest(sum(x * x), sum(y * y) / count(*)), 0)", "m < 1e-6", (0.0, True)),
    Diagnostic("signal_transform", "check_inverse_reconstruction", "sqrt(sum((x - y) * (x - y))) / nullif(sqrt(sum(x * x)), 0)", "m < 1e-10", (0.0, True)),
    Diagnostic("sorting", "measure_presortedness", _count("x > n") + " / nullif(CAST(count(*) - 1 AS DOUBLE), 0)", _NONE, (0.0, None), [window(n="lead(x) OVER w")]),
    Diagnostic("sorting", "analyze_comparison_count", "CASE WHEN count(*) <= 1 THEN 0.0 ELSE sum(i) / (2 * count(*) * log2(count(*))) END", "m > 1", (0.0, False)),
    Diagnostic("sorting", "analyze_swap_count", "CASE WHEN count(*) <= 1 THEN 0.0 ELSE sum(j) / (2 * count(*) * log2(count(*))) END", "m > 1", (0.0, False)),
    Diagnostic("sorting", "validate_stability", _count("i = ni AND pos > np"), "m = 0", (0.0, True), [window(ni="lead(i) OVER (PARTITION BY g ORDER BY i, x, pos)", np="lead(pos) OVER (PARTITION BY g ORDER BY i, x, pos)")]),
    Diagnostic("sequential_filter", "detect_filter_divergence", _share("z * z / (y * 50 + 1) > pow(1 - 2.0 / 9 + 1.645 * sqrt(2.0 / 9), 3)"), "m > 0", (0.0, False)),
    Diagnostic("sequential_filter", "adapt_process_noise", "sum(0.1 * pow(CAST(0.9 AS DOUBLE), t - 1 - pos) * z * z / 4) + pow(CAST(0.9 AS DOUBLE), max(t))", _NONE, (1.0, None), [window(t="count(*) OVER wg")]),
    Diagnostic("string_matching", "validate_failure_function", "sum(CASE WHEN pos = 0 THEN CASE WHEN i > 0 THEN 1 ELSE 0 END ELSE CASE WHEN i >= pos THEN 1 ELSE 0 END + CASE WHEN i < -1 THEN 1 ELSE 0 END END)", "m = 0", (0.0, True)),
    Diagnostic("string_matching", "measure_hash_collision_rate", _share("i = 1 AND j <> 1"), "m > 0.5", (0.0, False)),
    Diagnostic("vi_advi", "monitor_elbo_convergence", "CASE WHEN count(*) >= 2 THEN abs(avg(CASE WHEN r <= w THEN x END) - avg(CASE WHEN r > w AND r <= 2 * w THEN x END)) / greatest(abs(avg(CASE WHEN r > w AND r <= 2 * w THEN x END)), 1e-30) END", "m < 1e-4", (0.0, False),
        [window(r="row_number() OVER wd", t="count(*) OVER wg"), window(w="greatest(least({window}, CAST(floor(t / 2) AS INT)), 1)")], {"window": 10}),
    Diagnostic("vi_advi", "analyze_gradient_variance", "avg(cv)", "m < 1", (0.0, True), [group("i", cv="stddev_pop(x) / nullif(abs(avg(x)), 0)")]),
    Diagnostic("vi_advi", "detect_posterior_collapse", _count("x < {threshold}"), "m > 0", (0.0, False), params={"threshold": 0.5}),
    Diagnostic("vi_advi", "check_step_size_stability", "stddev_pop(x) / nullif(avg(x), 0)", "m < 0.5", (0.0, True)),
]

BY_KEY = {d.key: d for d in DIAGNOSTICS}
