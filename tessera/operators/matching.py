"""Matching of nodes, primitives, documents and candidates by weighted evidence: expressions for the parts, operators for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of categories that are near each other.
NEAR = {"signal_filter": "signal", "signal_transform": "signal", "signal_detect_measure": "signal", "kalman_filter": "filter", "particle_filter": "filter", "sequential_filter": "filter", "graph_traversal": "graph", "graph_optimization": "graph", "graph_signal_processing": "graph"}


def le_fuzzy(a: Column, b: Column, tol: float = 1e-9) -> Column:
    return (a < b) | (F.abs(a - b) < tol)


def ge_fuzzy(a: Column, b: Column, tol: float = 1e-9) -> Column:
    return (a > b) | (F.abs(a - b) < tol)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def type_bonus(query: Column, signature: Column) -> Column:
    """A tenth for each token both arrays hold, three tenths at most."""
    return F.least(F.size(F.array_intersect(query, signature)) * 0.1, F.lit(0.3))


def port_bonus(a: Column, b: Column) -> Column:
    """Twice the Jaccard similarity of the names of ports, without case and marks; null names don't count."""
    norm = lambda c: F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_")))
    return 2 * jaccard(norm(a), norm(b))


def category_bonus(a: Column, b: Column) -> Column:
    near = F.create_map(*[F.lit(x) for p in NEAR.items() for x in p])
    return F.when(a == b, 1.5).when(F.try_element_at(near, a) == F.try_element_at(near, b), 0.5).otherwise(0.0)


def arity_bonus(n_in: Column, n_out: Column, required: Column, total: Column, outs: Column) -> Column:
    """Whether a node's ports suit a primitive's: its inputs from required to total, its outputs."""
    i = F.when(n_in.between(required, total), 1.5).otherwise(-0.25 * F.abs(n_in - required))
    return i + F.when(n_out == outs, 0.75).when(outs != 0, -0.1 * F.abs(n_out - outs)).otherwise(0.0)


def io_factor(n_in: Column, n_out: Column, c_in: Column, c_out: Column) -> Column:
    """1 less 0.15 for each port of difference; 1 for a candidate without ports."""
    return F.when((c_in == 0) & (c_out == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 0.15 * (F.abs(n_in - c_in) + F.abs(n_out - c_out))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Items two arrays share, repeats counted, over the larger one's size; 1 if both are empty."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.least(F.size(F.filter(a, lambda x: x == v)), F.size(F.filter(b, lambda x: x == v))))
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, 1.0).otherwise(shared / n)


def witness_match(signatures: Column, types: Column) -> Column:
    """The share of signatures among a candidate's types; 1 if it has none."""
    n = F.size(signatures)
    return F.when(F.size(types) == 0, 1.0).when(n == 0, 0.0).otherwise(F.size(F.filter(signatures, lambda s: F.array_contains(types, s))) / n)


#: The weights of the parts of an alignment.
ALIGNMENT = {"concept": 0.25, "io": 0.15, "child": 0.25, "topo": 0.15, "type_class": 0.10, "witness": 0.10}


def alignment(**parts: Column) -> Column:
    """The weighted sum of an alignment's parts (see ALIGNMENT); each is from 0 to 1."""
    return sum((w * parts[k] for k, w in ALIGNMENT.items()), F.lit(0.0))


def interval_inside(lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """Whether a requested interval lies in the available one; an end that is null is open."""
    return (low.isNull() | (lo >= low)) & (high.isNull() | (hi <= high))


def equal_ratios(a: Column, b: Column) -> Column:
    """Whether two arrays of exponents, in the order of their shared names, are proportional; false below two names."""
    cross = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.abs(F.get(a, F.lit(0)) * F.get(b, i) - F.get(a, i) * F.get(b, F.lit(0))) < 1e-9)
    return (F.size(a) >= 2) & (F.size(a) == F.size(b)) & F.forall(cross, lambda x: x)


def top_matches(nodes: DataFrame, prims: DataFrame, k: int) -> DataFrame:
    """(node_id, name, score) of the k best primitives of each node that share a word with it.

    `nodes` has node_id, words, ports (arrays), category, n_in, n_out; `prims` has name, words, ports, category, required,
    total, outs; node_id and name are unique. The score adds the inverse document frequencies of shared words (over the
    primitives), the bonuses of ports, category and arity, and 20 for an equal name. Ties go to the lesser name.

    A word that most primitives have weighs next to nothing, but none is left out. Sets of words meet, not nodes and
    primitives: of primitives alike in the words that nodes have and in all else, only the k least names count; of
    primitives alike in all but words, only the k best for a node's set of words (and the k first by name, for nodes whose
    score is null) can be among its k best. The primitive of a node's own name is held against it apart.
    """
    c = F.col
    other = ["pb", "cb", "required", "total", "outs"]
    n = prims.select("name").distinct().agg(F.count(F.lit(1)).alias("n"))
    words = prims.select("name", F.explode(F.array_distinct("words")).alias("w"))
    idf = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", F.log(c("n") / c("df")).alias("idf"))  # n is one row
    a = nodes.select("node_id", F.array_sort(F.array_distinct("words")).alias("ws"), c("ports").alias("pa"), c("category").alias("ca"), "n_in", "n_out")
    b = prims.select("name", c("ports").alias("pb"), c("category").alias("cb"), "required", "total", "outs")
    # sets of words, without those that the other side lacks
    sets = a.select("ws").distinct().withColumn("w", F.explode("ws"))
    held = sets.join(idf, "w").groupBy("ws").agg(F.array_sort(F.collect_list(F.struct("w", "idf"))).alias("kn"))
    there = words.join(sets.select("w").distinct(), "w", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("w")).alias("kp"))
    named = there.join(b, "name")
    meet = held.select("kn").distinct().select("kn", F.explode("kn.w").alias("w")).join(there.select("kp").distinct().select("kp", F.explode("kp").alias("w")), "w").select("kn", "kp").distinct()
    shared = F.filter("kn", lambda x: F.array_contains(c("kp"), x["w"]))
    tfidf = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x["idf"])  # in the order of the words, so that equal sets weigh the same
    least = named.withColumn("_r", F.row_number().over(Window.partitionBy("kp", *other).orderBy("name"))).where(c("_r") <= k).drop("_r")
    first = lambda *order: F.row_number().over(Window.partitionBy("kn", *other).orderBy(*order)) <= k
    best = meet.withColumn("tfidf", tfidf).join(least, "kp").select("*", first(c("tfidf").desc(), "name").alias("_s"), first("name").alias("_n")).where("_s OR _n")  # by name for nodes without a score
    sides = ["node_id", "name", "tfidf", "pa", "ca", "n_in", "n_out", *other]
    found = a.join(held.join(best, "kn").drop("kn", "kp", "_s", "_n"), "ws").where(c("node_id") != c("name")).select(*sides)
    own = a.join(named, c("node_id") == c("name")).join(held, "ws").where(F.size(shared) > 0).withColumn("tfidf", tfidf).select(*sides)
    score = c("tfidf") + port_bonus(c("pa"), c("pb")) + category_bonus(c("ca"), c("cb")) + arity_bonus(c("n_in"), c("n_out"), c("required"), c("total"), c("outs")) + F.when(c("node_id") == c("name"), 20.0).otherwise(0.0)
    scored = found.unionByName(own).select("node_id", "name", score.alias("score"))
    w = Window.partitionBy("node_id").orderBy(F.col("score").desc(), "name")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def merge_indices(hits: DataFrame, query: str, name: str, score: str, k: int) -> DataFrame:
    """The k best names of each query over several indices' hits; a name counts once, with its best score."""
    best = hits.groupBy(query, name).agg(F.max(score).alias(score))
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), name)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def richest(rows: DataFrame, keys: list[str], richness: Column, keep: list[str]) -> DataFrame:
    """The richest of the rows that count as duplicates (equal `keys`); ties go to the greatest values."""
    return rows.groupBy(*keys).agg(F.max(F.struct(richness.alias("_n"), *keep)).alias("_b"), F.count(F.lit(1)).alias("n_merged")).select(*keys, *[f"_b.{c}" for c in keep], "n_merged")


def weak_spots(best: DataFrame, score: str, ceiling: float) -> DataFrame:
    """Nodes whose best score stays below the ceiling (or that have none)."""
    return best.where(F.coalesce(F.col(score), F.lit(0.0)) < ceiling)


def recency_overlap(items: DataFrame, space: str, at: str, words: Column, query: list[str], k: int) -> DataFrame:
    """The k best items of each namespace: the share of the query's words they hold, and a hundredth of the recency rank's share.

    An empty query ranks by recency alone.
    """
    q = F.array(*map(F.lit, query))
    rank = F.percent_rank().over(Window.partitionBy(space).orderBy(at))
    overlap = F.size(F.array_intersect(words, q)) / F.lit(float(max(1, len(set(query))))) if query else F.lit(0.0)
    s = items.withColumn("score", overlap + 0.01 * rank)
    if query:
        s = s.where(F.arrays_overlap(words, q))
    w = Window.partitionBy(space).orderBy(F.col("score").desc(), F.col(at).desc(), *[c for c in items.columns if c not in (space, at)][:1])
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def layered(hits: DataFrame, key: str, layer: str, score: str, limit: int) -> DataFrame:
    """The first layer that found a key wins; the `limit` best by layer and score."""
    first = hits.groupBy(key).agg(F.min(F.struct(F.col(layer), (-F.col(score)).alias("_s"))).alias("_b")).select(key, F.col(f"_b.{layer}").alias(layer), (-F.col("_b._s")).alias(score))
    return first.orderBy(layer, F.col(score).desc(), key).limit(limit)
