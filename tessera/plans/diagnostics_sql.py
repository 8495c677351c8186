"""The numeric diagnostics stated a second time, for DuckDB, from their definitions.

Here a group is one row of lists in series order (xs, ys, zs, ii, jj, bs, ks, of length n), and each metric is a list
expression. Nothing is shared with the chains of window and group steps that Spark runs, so a wrong formula on either
side shows as a difference.
"""

from __future__ import annotations


def t(expr: str, over: str = "range(n)") -> str:
    """A list of `expr` for each position p (from 0)."""
    return f"list_transform({over}, lambda p: {expr})"


def total(expr: str, over: str = "range(n)") -> str:
    return f"coalesce(list_sum({t(f'CAST({expr} AS DOUBLE)', over)}), 0.0)"


def count(test: str, over: str = "range(n)") -> str:
    return f"len(list_filter({over}, lambda p: coalesce({test}, FALSE)))"


def share(test: str) -> str:
    return f"CAST({count(test)} AS DOUBLE) / n"


X, Y, Z, I, J = ("xs[p + 1]", "ys[p + 1]", "zs[p + 1]", "ii[p + 1]", "jj[p + 1]")
NEXT = "xs[p + 2]"
#: Positions that have one after them, and two.
PAIRS, TRIPLES = "range(n - 1)", "range(n - 2)"
LABELS = "list_distinct(ii)"
INF = "CAST('infinity' AS DOUBLE)"


def by_label(expr: str) -> str:
    """A list with `expr` over `at` (the positions of one label) for each label."""
    return f"list_transform({LABELS}, lambda l: {expr.replace('AT', 'list_filter(range(n), lambda q: ii[q + 1] = l)')})"


_own = lambda e: f"list_transform(AT, lambda p: {e})"
NORMS = by_label(f"sqrt(list_sum({_own(f'{X} * {X}')}))")
SIZES = by_label("len(AT)")
NORM = lambda e: f"sqrt({total(f'({e}) * ({e})')})"
GAPS = t(f"{NEXT} - {X}", PAIRS)
RATIOS = t(f"{NEXT} / {X}", f"list_filter({PAIRS}, lambda p: {X} <> 0)")
SIZE_GAPS = t(f"abs({NEXT} - {X})", PAIRS)
#: log-ratios of sizes of steps that follow each other, both above 0
STEPS = f"list_filter({TRIPLES}, lambda p: abs({NEXT} - {X}) > 0 AND abs(xs[p + 3] - {NEXT}) > 0)"
LATER = f"list_filter({TRIPLES}, lambda p: abs({NEXT} - {X}) > 0)"
SORTED = "list_sort(xs)"
BINS = "list_transform(range(10), lambda k: len(list_filter(xs, lambda v: least(CAST(floor((v - list_min(xs)) / (list_max(xs) - list_min(xs)) * 10) AS INT), 9) = k)))"
LINE = lambda us, vs: (  # noqa: E731  the slope of us over vs by sums of products of deviations
    f"(list_sum(list_transform(range(len({us})), lambda q: ({us}[q + 1] - list_avg({us})) * ({vs}[q + 1] - list_avg({vs})))) / nullif(list_sum(list_transform({vs}, lambda v: pow(v - list_avg({vs}), 2))), 0))"
)
POSITIVE = f"list_filter(range(n), lambda p: {X} > 0 AND {Y} > 0)"
CROSS = "((xs[(p + 1) % n + 1] - xs[p + 1]) * (ys[(p + 2) % n + 1] - ys[(p + 1) % n + 1]) - (ys[(p + 1) % n + 1] - ys[p + 1]) * (xs[(p + 2) % n + 1] - xs[(p + 1) % n + 1]))"
TURNS = f"list_filter({t(f'sign({CROSS})')}, lambda s: s <> 0)"
POINTS = "list_sort(list_transform(range(n), lambda q: struct_pack(a := xs[q + 1], b := ys[q + 1])))"
STABLE = "list_sort(list_transform(range(n), lambda q: struct_pack(a := ii[q + 1], b := xs[q + 1], c := q)))"
PART = lambda v: f"list_filter(range(n), lambda p: ks[p + 1] = {v})"
ENERGY = f"list_transform(list_distinct(ks), lambda l: list_sum(list_transform({PART('l')}, lambda p: {X} * {X})))"
LIMIT = "pow(1 - 2.0 / 9 + 1.645 * sqrt(2.0 / 9), 3)"
NIS = f"{Z} * {Z} / ({Y} * 50 + 1)"
MEAN = "list_avg(xs)"
ACF = lambda k: f"abs(list_sum({t(f'(xs[p + 1] - {MEAN}) * (xs[p + 1 + {k}] - {MEAN})', f'range(n - {k})')}) / (n - {k}))"
ELBO = "greatest(least(10, n // 2), 1)"
#: The positions that come before p in order of xs.
BEFORE = f"list_filter(range(n), lambda u: xs[u + 1] < {X} OR (xs[u + 1] = {X} AND u < p))"

#: name: (metric, flag over m and n, metric and flag where the metric is null)
DEFINED: dict[str, tuple[str, str, str, str]] = {
    "baseline_analysis_check_onset_coverage": ("n / 1000.0", "m >= 1e-4", "0.0", "FALSE"),
    "baseline_analysis_detect_padding_saturation": ("CASE WHEN n > 50 THEN (n - 50) / CAST(n AS DOUBLE) ELSE 0 END", "m > 0.5", "0.0", "FALSE"),
    "baseline_analysis_monitor_normalization_clipping": (share(f"abs({X} - 1) <= 1e-8 + 1e-5 + 1e-8"), "m > 0.1", "0.0", "FALSE"),
    "baseline_analysis_validate_component_balance": (f"CASE WHEN len(list_distinct(ks)) <= 1 OR list_sum({ENERGY}) = 0 THEN 1.0 ELSE -list_sum(list_transform({ENERGY}, lambda e: CASE WHEN e > 0 THEN e / list_sum({ENERGY}) * log2(e / list_sum({ENERGY})) ELSE 0.0 END)) / log2(len(list_distinct(ks))) END", "m >= 0.5", "1.0", "TRUE"),
    "belief_propagation_monitor_message_convergence": ("xs[n]", "m < 1e-6", "0.0", "TRUE"),
    "belief_propagation_validate_belief_normalization": (f"list_max({by_label(f'abs(list_sum({_own(X)}) - 1)')})", "m < 1e-8", "0.0", "TRUE"),
    "belief_propagation_analyze_message_damping": (f"CASE WHEN n < 3 THEN NULL ELSE CAST({count(f'({NEXT} - {X}) * (xs[p + 3] - {NEXT}) < 0', TRIPLES)} AS DOUBLE) / (n - 2) END", "m > 0.1", "0.0", "FALSE"),
    "clustering_analyze_cluster_balance": (f"list_max({SIZES}) / CAST(list_min({SIZES}) AS DOUBLE)", "m <= 10", "1.0", "TRUE"),
    "clustering_monitor_assignment_stability": (share(f"{I} <> {J}"), "m <= 0.01", "0.0", "TRUE"),
    "clustering_detect_empty_clusters": (count(f"{I} = 0"), "m > 0", "0.0", "FALSE"),
    "clustering_validate_separation": (f"CASE WHEN list_sum(ys) = 0 THEN {INF} ELSE list_avg(xs) / list_avg(ys) END", "m >= 1", "1.0", "TRUE"),
    "combinatorics_analyze_branching_factor": ("list_avg(ii)", "m <= 10", "0.0", "TRUE"),
    "combinatorics_monitor_bound_tightness": ("(xs[n] - ys[n]) / CASE WHEN abs(xs[n]) > 1 THEN abs(xs[n]) ELSE 1 END", "m <= 0.5", "0.0", "TRUE"),
    "combinatorics_detect_symmetry": (share("bs[p + 1]"), "m > 0.3", "0.0", "FALSE"),
    "combinatorics_check_pruning_effectiveness": (share("ks[p + 1] = 'view'"), "m >= 0.1", "0.0", "FALSE"),
    "compression_analyze_compression_ratio": ("CASE WHEN list_sum(ys) / CASE WHEN list_sum(xs) > 1 THEN list_sum(xs) ELSE 1 END > 0.5 THEN list_sum(ys) / CASE WHEN list_sum(xs) > 1 THEN list_sum(xs) ELSE 1 END - 0.5 ELSE 0 END", "m <= 0.2", "0.0", "TRUE"),
    "compression_validate_lossless_roundtrip": (share(f"{I} <> {J}"), "m = 0", "0.0", "TRUE"),
    "compression_detect_dictionary_bloat": ("CASE WHEN n < 2 THEN 1.0 ELSE CASE WHEN xs[n] > 0 THEN xs[n] ELSE 0 END / CASE WHEN xs[1] > 1 THEN xs[1] ELSE 1 END END", "m <= 2", "1.0", "TRUE"),
    "compression_monitor_encoding_throughput": (f"CASE WHEN list_sum(ys) <= 0 THEN {INF} ELSE list_sum(xs) / list_sum(ys) END", "m >= 1000", INF, "TRUE"),
    "dimensionality_reduction_analyze_explained_variance": (f"{total(f'abs({X})')} / nullif({total(f'abs({X})')}, 0)", "m >= 0.95", "0.0", "FALSE"),
    "dimensionality_reduction_detect_crowding": (f"CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, 1 - {total(f'pow(p - len({BEFORE}), 2)')} / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1) / 3)) END", "m >= 0.9", "1.0", "TRUE"),
    "dimensionality_reduction_check_reconstruction_error": (f"{NORM(f'{X} - {Y}')} / nullif({NORM(X)}, 0)", "m <= 0.1", "0.0", "TRUE"),
    "divide_and_conquer_measure_split_balance": (f"list_avg({t(f'CASE WHEN {X} < {Y} THEN {X} / {Y} WHEN {X} > 0 THEN {Y} / {X} END')})", "NULL", "1.0", "NULL"),
    "divide_and_conquer_check_recursion_depth": ("CASE WHEN n <= 1 THEN 0.0 ELSE list_max(ii) / (2 * log2(n)) END", "m > 1", "0.0", "FALSE"),
    "divide_and_conquer_profile_merge_cost": (f"list_avg({t(f'{X} / nullif({X} + {Y}, 0)')})", "NULL", "0.0", "NULL"),
    "divide_and_conquer_detect_subproblem_overlap": (f"(n - len({LABELS})) / CAST(n AS DOUBLE)", "NULL", "0.0", "NULL"),
    "dynamic_programming_detect_table_sparsity": (f"1 - {share(f'{I} = 0')}", "NULL", "0.0", "NULL"),
    "dynamic_programming_compress_dp_table": ("CASE WHEN n <= 10 THEN 0.0 ELSE (n - 10) / CAST(n AS DOUBLE) END", "NULL", "0.0", "NULL"),
    "dynamic_programming_validate_subproblem_overlap": ("list_avg(list_filter(ii, lambda v: v > 0))", "m > 1.5", "0.0", "FALSE"),
    "geometry_detect_duplicate_points": (f"len(list_filter(range(n - 1), lambda p: sqrt(pow({POINTS}[p + 2].a - {POINTS}[p + 1].a, 2) + pow({POINTS}[p + 2].b - {POINTS}[p + 1].b, 2)) < 0.05))", "m > 0", "0.0", "FALSE"),
    "geometry_validate_convexity": (f"CASE WHEN n < 3 THEN 0 ELSE len(list_filter({TURNS}, lambda s: s <> {TURNS}[1])) END", "m = 0", "0.0", "TRUE"),
    "graph_optimization_detect_negative_weights": (count(f"{Z} < 0"), "m > 0", "0.0", "FALSE"),
    "graph_optimization_monitor_relaxation_convergence": (
        # steps of ten values; the first whose values all are close to those ten places before
        "coalesce(list_min(list_filter(range(1, (n + 9) // 10), lambda k: len(list_filter(range(10 * k, least(10 * k + 10, n)), lambda p: abs(xs[p + 1] - xs[p - 9]) > 1e-8 + 1e-5 * abs(xs[p - 9]))) = 0)), -1)", "m >= 0", "-1.0", "FALSE"),
    "graph_optimization_detect_distance_overflow": (count(f"{X} > 400"), "m > 0", "0.0", "FALSE"),
    "graph_optimization_analyze_graph_density": (f"CASE WHEN len({LABELS}) <= 1 THEN 0.0 ELSE CAST(n AS DOUBLE) / (len({LABELS}) * (len({LABELS}) - 1)) END", "m > 0.5", "0.0", "FALSE"),
    "graph_signal_processing_analyze_spectral_gap": (f"{SORTED}[2]", "m > 0.01", "0.0", "FALSE"),
    "graph_signal_processing_validate_filter_response": ("greatest(abs(list_max(xs)), abs(list_min(xs)))", "m < 100", "0.0", "TRUE"),
    "graph_traversal_detect_frontier_overflow": ("list_max(xs) / ceil(sqrt(n))", "m > 1", "0.0", "FALSE"),
    "greedy_detect_criterion_ties": (f"len(list_filter(range(n), lambda p: (p > 0 AND {SORTED}[p + 1] - {SORTED}[p] <= 1e-8) OR (p < n - 1 AND {SORTED}[p + 2] - {SORTED}[p + 1] <= 1e-8)))", "m > 0", "0.0", "FALSE"),
    "greedy_estimate_solution_quality": ("CASE WHEN list_sum(xs) + list_sum(ys) = 0 THEN NULL ELSE least(greatest(list_sum(xs) / (list_sum(xs) + list_sum(ys)), 0), 1) END", "m >= 0.99", "0.0", "FALSE"),
    "greedy_detect_redundant_feasibility": (share("bs[p + 1]"), "m = 1", "1.0", "TRUE"),
    "information_theory_check_distribution_support": (share(f"{Z} <= 0"), "m = 0", "0.0", "TRUE"),
    "information_theory_analyze_sample_sufficiency": (f"n / CAST(len({LABELS}) AS DOUBLE)", "m >= 5", "0.0", "FALSE"),
    "information_theory_detect_numerical_underflow": (share(f"{X} > 140"), "m <= 0.05", "0.0", "TRUE"),
    "information_theory_validate_information_inequality": (f"greatest(list_max({t(f'{X} - {Y}')}), 0)", "m <= 1e-9", "0.0", "TRUE"),
    "kalman_filter_check_innovation_consistency": (f"list_avg({t(NIS)})", "m >= 0.5 AND m <= 2", "0.0", "TRUE"),
    "kalman_filter_analyze_kalman_gain_magnitude": (f"list_max({NORMS})", "m < 100", "0.0", "TRUE"),
    "kalman_filter_check_state_smoothness": (f"CASE WHEN n < 2 THEN NULL ELSE len(list_filter({SIZE_GAPS}, lambda v: v > 5 * list_median({SIZE_GAPS}))) END", "NULL", "0.0", "NULL"),
    "linear_algebra_validate_decomposition_accuracy": (f"{NORM(f'{X} - {Y}')} / nullif({NORM(X)}, 0)", "m <= 1e-8", "0.0", "TRUE"),
    "linear_algebra_detect_rank_deficiency": (f"len(list_filter(xs, lambda v: abs(v) > 1e-10 * greatest(abs(list_max(xs)), abs(list_min(xs)))))", "m >= 10", "0.0", "FALSE"),
    "linear_algebra_monitor_iterative_convergence": (f"exp(list_avg({t(f'ln({NEXT}) - ln({X})', f'list_filter({PAIRS}, lambda p: {X} > 0 AND {NEXT} > 0)')}))", "m < 0.99", "0.0", "TRUE"),
    "mcmc_detect_divergent_transitions": (count(f"{X} - {Y} > 100 OR {Y} - {X} > 100"), "m > 0", "0.0", "FALSE"),
    "mcmc_estimate_mass_matrix": ("CASE WHEN n < 2 THEN 1.0 ELSE greatest(list_var_samp(xs), 1e-3) END", "NULL", "1.0", "NULL"),
    "neural_network_detect_gradient_explosion": (f"list_max({NORMS})", "m > 100", "0.0", "FALSE"),
    "neural_network_analyze_activation_statistics": (share(f"{I} = 0"), "m > 0.5", "0.0", "FALSE"),
    "neural_network_monitor_loss_convergence": ("CASE WHEN n < 2 THEN NULL ELSE abs(xs[n] - xs[n - 1]) / nullif(abs(xs[n - 1]), 0) END", "m < 1e-6", "1.0", "FALSE"),
    "neural_network_check_weight_distribution": (f"CASE WHEN list_min({NORMS}) = 0 THEN {INF} ELSE list_max({NORMS}) / list_min({NORMS}) END", "m <= 100", "1.0", "TRUE"),
    "number_theory_validate_input_range": (count(f"{X} > 65.536 OR {X} < -65.536"), "m = 0", "0.0", "TRUE"),
    "number_theory_monitor_gcd_convergence": (f"list_avg({RATIOS})", "NULL", "0.0", "NULL"),
    "ode_solver_monitor_step_rejection_rate": (share("NOT bs[p + 1]"), "m <= 0.5", "0.0", "TRUE"),
    "ode_solver_detect_stiffness": ("list_max(list_transform(xs, lambda v: abs(v))) / list_min(list_filter(list_transform(xs, lambda v: abs(v)), lambda v: v > 0))", "m > 1e6", "1.0", "FALSE"),
    "ode_solver_check_energy_conservation": ("greatest(list_max(xs) - xs[1], xs[1] - list_min(xs))", "m <= 1e-6", "0.0", "TRUE"),
    "ode_solver_validate_order_of_accuracy": (LINE(f"{t(f'ln({X})', POSITIVE)}", f"{t(f'ln({Y})', POSITIVE)}"), "m >= 1.6", "0.0", "TRUE"),
    "optimization_detect_vanishing_gradient": (f"list_min({NORMS})", "m < 1e-15", "0.0", "FALSE"),
    "optimization_analyze_loss_landscape": (f"CASE WHEN list_contains(xs, 0) THEN {INF} ELSE list_max(list_transform(xs, lambda v: abs(v))) / list_min(list_transform(xs, lambda v: abs(v))) END", "m > 1e10", "1.0", "FALSE"),
    "optimization_check_constraint_violation": ("greatest(5 - list_min(xs), list_max(xs) - 100, 0)", "m <= 0", "0.0", "TRUE"),
    "optimization_monitor_convergence_rate": (f"greatest(-list_avg({t(f'ln(abs(xs[p + 3] - {NEXT}) / abs({NEXT} - {X}))', STEPS)}), 0)", "m >= 0.5", "1.0", "TRUE"),
    "particle_filter_monitor_effective_sample_size": (f"pow({total(f'exp({X} - list_max(xs))')}, 2) / {total(f'pow(exp({X} - list_max(xs)), 2)')} / n", "m > 0.5", "0.0", "FALSE"),
    "particle_filter_track_weight_variance": (LINE(by_label(f"list_var_pop({_own(X)})"), LABELS), "m <= 0", "0.0", "TRUE"),
    "particle_filter_check_resampling_quality": (f"list_max({SIZES}) / CAST(n AS DOUBLE)", "m < 0.1", "0.0", "TRUE"),
    "quadrature_analyze_integrand_smoothness": (f"list_max({t(f'abs({NEXT} - {X}) / nullif(abs(ys[p + 2] - {Y}), 0)', PAIRS)})", "m <= 1e6", "0.0", "TRUE"),
    "quadrature_detect_singularity": ("greatest(abs(list_max(xs)), abs(list_min(xs)))", "m <= 1e10", "0.0", "TRUE"),
    "quadrature_monitor_convergence_rate": (f"list_avg({t(f'abs(xs[p + 3] - {NEXT}) / abs({NEXT} - {X})', LATER)})", "m < 0.5", "0.0", "TRUE"),
    "quadrature_check_domain_coverage": (f"list_max(list_transform(range(n + 1), lambda q: (list_concat({SORTED}, [500.0])[q + 1] - list_concat([0.0], {SORTED})[q + 1]))) / 500", "m <= 0.1 + 1e-12", "0.0", "TRUE"),
    "randomized_validate_hash_independence": ("list_sum(ii) / nullif(CAST(list_sum(jj) AS DOUBLE), 0)", "m <= 2", "0.0", "TRUE"),
    "randomized_analyze_sketch_accuracy": (f"list_avg({t(f'abs({X} - {Y}) / CASE WHEN abs({X}) > 1e-12 THEN abs({X}) ELSE 1e-12 END')})", "m <= 0.1", "0.0", "TRUE"),
    "randomized_monitor_sample_coverage": (f"len({LABELS}) / 13.0", "m >= 0.1", "0.0", "FALSE"),
    "randomized_check_concentration_bound": (share(f"{X} > 100"), "m <= 0.05", "0.0", "TRUE"),
    "searching_validate_sorted_order": (count(f"{NEXT} < {X}", PAIRS), "m = 0", "0.0", "TRUE"),
    "searching_analyze_distribution_uniformity": (f"CASE WHEN n <= 2 THEN 1.0 ELSE coalesce(greatest(0.0, 1 - sqrt(list_var_pop(list_filter({GAPS}, lambda v: v > 0))) / list_avg(list_filter({GAPS}, lambda v: v > 0)) / 2), 0.0) END", "n > 2 AND m > 0.7", "0.0", "FALSE"),
    "searching_analyze_iteration_count": ("CASE WHEN n <= 1 THEN 0.0 ELSE (n - 1) / (2 * log2(n)) END", "m > 1", "0.0", "FALSE"),
    "sequential_filter_validate_innovation_whiteness": (f"CASE WHEN n < 12 OR list_var_pop(xs) < 1e-15 THEN NULL ELSE greatest({', '.join(ACF(k) for k in range(1, 11))}) / list_var_pop(xs) END", "m < 1.96 / sqrt(n)", "0.0", "TRUE"),
    "signal_detect_measure_estimate_snr": (f"CASE WHEN n < 2 THEN NULL WHEN list_median(list_transform(xs, lambda v: abs(v - list_median(xs)))) = 0 THEN {INF} ELSE 10 * log10(greatest(list_avg(list_transform(xs, lambda v: v * v)) / pow(list_median(list_transform(xs, lambda v: abs(v - list_median(xs)))) * 1.4826, 2), 1e-30)) END", "m > 10", "0.0", "FALSE"),
    "signal_detect_measure_analyze_peak_threshold_sensitivity": (share(f"{X} >= 18 AND {X} <= 22"), "m < 0.2", "0.0", "TRUE"),
    "signal_detect_measure_check_event_rate_stationarity": (f"CASE WHEN list_max(xs) > list_min(xs) THEN sqrt(list_var_pop({BINS})) / list_avg({BINS}) END", "m < 0.5", "0.0", "TRUE"),
    "signal_detect_measure_estimate_false_positive_rate": (share(f"{X} < 30"), "m < 0.05", "0.0", "TRUE"),
    "signal_filter_analyze_pole_stability": (f"sqrt(list_max({t(f'{X} * {X} + {Y} * {Y}')}))", "m < 1", "0.0", "TRUE"),
    "signal_filter_measure_passband_ripple": (f"list_max({t(X, 'list_filter(range(n), lambda p: bs[p + 1])')}) - list_min({t(X, 'list_filter(range(n), lambda p: bs[p + 1])')})", "m < 1", "0.0", "TRUE"),
    "signal_filter_analyze_group_delay_variation": ("CASE WHEN n < 2 THEN 0.0 ELSE list_max(ys) - list_min(ys) END", "m < 1", "0.0", "TRUE"),
    "signal_filter_detect_transient_response": (f"{total(f'{X} * {X}', 'range(least(10, n))')} / nullif({total(f'{X} * {X}')}, 0)", "NULL", "0.0", "NULL"),
    "signal_transform_analyze_window_leakage": (f"least(greatest(1 - {total(f'{Y} * {Y}')} / nullif({total(f'{X} * {X}')}, 0), 0), 1)", "m > 0.5", "0.0", "FALSE"),
    "signal_transform_detect_spectral_aliasing": (f"{total(f'{X} * {X}', 'range(CAST(floor(0.9 * n) AS BIGINT), n)')} / nullif({total(f'{X} * {X}')}, 0)", "m > 0.1", "0.0", "FALSE"),
    "signal_transform_validate_parseval_energy": (f"abs({total(f'{X} * {X}')} - {total(f'{Y} * {Y}')} / n) / nullif(greatest({total(f'{X} * {X}')}, {total(f'{Y} * {Y}')} / n), 0)", "m < 1e-6", "0.0", "TRUE"),
    "signal_transform_check_inverse_reconstruction": (f"{NORM(f'{X} - {Y}')} / nullif({NORM(X)}, 0)", "m < 1e-10", "0.0", "TRUE"),
    "sorting_measure_presortedness": (f"CASE WHEN n < 2 THEN NULL ELSE CAST({count(f'{X} > {NEXT}', PAIRS)} AS DOUBLE) / (n - 1) END", "NULL", "0.0", "NULL"),
    "sorting_analyze_comparison_count": ("CASE WHEN n <= 1 THEN 0.0 ELSE list_sum(ii) / (2 * n * log2(n)) END", "m > 1", "0.0", "FALSE"),
    "sorting_analyze_swap_count": ("CASE WHEN n <= 1 THEN 0.0 ELSE list_sum(jj) / (2 * n * log2(n)) END", "m > 1", "0.0", "FALSE"),
    "sorting_validate_stability": (f"len(list_filter({PAIRS}, lambda p: {STABLE}[p + 1].a = {STABLE}[p + 2].a AND {STABLE}[p + 1].c > {STABLE}[p + 2].c))", "m = 0", "0.0", "TRUE"),
    "sequential_filter_detect_filter_divergence": (share(f"{NIS} > {LIMIT}"), "m > 0", "0.0", "FALSE"),
    "sequential_filter_adapt_process_noise": (
        # the recurrence q = 0.9 q + 0.1 k y y k, from 1
        "list_reduce(list_concat([1.0], list_transform(zs, lambda v: 0.1 * (v / 2) * (v / 2))), lambda q, e: 0.9 * q + e)", "NULL", "1.0", "NULL"),
    "string_matching_validate_failure_function": (f"CASE WHEN ii[1] > 0 THEN 1 ELSE 0 END + {count(f'p > 0 AND {I} >= p')} + {count(f'p > 0 AND {I} < -1')}", "m = 0", "0.0", "TRUE"),
    "string_matching_measure_hash_collision_rate": (share(f"{I} = 1 AND {J} <> 1"), "m > 0.5", "0.0", "FALSE"),
    "vi_advi_monitor_elbo_convergence": (f"CASE WHEN n < 2 THEN NULL ELSE abs(list_avg(xs[n - {ELBO} + 1 : n]) - list_avg(xs[n - 2 * {ELBO} + 1 : n - {ELBO}])) / greatest(abs(list_avg(xs[n - 2 * {ELBO} + 1 : n - {ELBO}])), 1e-30) END", "m < 1e-4", "0.0", "FALSE"),
    "vi_advi_analyze_gradient_variance": (f"list_avg({by_label(f'sqrt(list_var_pop({_own(X)})) / nullif(abs(list_avg({_own(X)})), 0)')})", "m < 1", "0.0", "TRUE"),
    "vi_advi_detect_posterior_collapse": (count(f"{X} < 0.5"), "m > 0", "0.0", "FALSE"),
    "vi_advi_check_step_size_stability": ("sqrt(list_var_pop(xs)) / nullif(list_avg(xs), 0)", "m < 0.5", "0.0", "TRUE"),
}


def sql(name: str, source: str) -> str:
    """One SELECT of g, metric (rounded to 6 places) and flag over `source` (g, pos, x, y, z, i, j, b, k)."""
    metric, flag, empty, empty_flag = DEFINED[name]
    cols = ", ".join(f"list({c} ORDER BY pos) AS {a}" for c, a in (("x", "xs"), ("y", "ys"), ("z", "zs"), ("i", "ii"), ("j", "jj"), ("b", "bs"), ("k", "ks")))
    lists = f"SELECT g, count(*) AS n, {cols} FROM ({source}) GROUP BY g"
    return f"WITH d AS (SELECT g, n, CAST({metric} AS DOUBLE) AS m FROM ({lists})) SELECT g, round(coalesce(m, {empty}), 6) AS metric, CAST(CASE WHEN m IS NULL THEN {empty_flag} ELSE {flag} END AS BOOLEAN) AS flag FROM d"
