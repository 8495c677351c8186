"""Graph and DAG operators on vertex and edge tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Written


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, n_in, n_out) of each end of an edge."""
    o = edges.select(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    i = edges.select(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    return o.unionByName(i).groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def _anchors(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, anchor, dist, done): the nearest node upward that has not just one predecessor, in rounds that double the reach.

    Nodes that are not done are on a cycle of nodes with one predecessor each, or behind it.
    """
    single = e.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).where("n = 1").select("node", "s")
    far = F.when(F.col("s").isNull(), 0).otherwise(1).cast("bigint")
    cur = Written(nodes.join(single, "node", "left").select("node", F.coalesce("s", "node").alias("anchor"), far.alias("dist"), F.col("s").isNull().alias("done")))
    left = -1
    while (n := cur.df.where("not done").count()) not in (0, left):
        left = n
        ahead = cur.df.select(F.col("node").alias("anchor"), F.col("anchor").alias("a2"), F.col("dist").alias("d2"), F.col("done").alias("done2"))
        moved = cur.df.where("not done").join(ahead, "anchor").select("node", F.col("a2").alias("anchor"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("done2").alias("done"))
        new = Written(cur.df.where("done").unionByName(moved))
        cur.drop()
        cur = new
    return cur.df


def topo_levels(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, level): the longest way from a node without predecessors; null for nodes on or behind a cycle.

    Runs of nodes with one predecessor each are jumped in a number of rounds that grows with the logarithm of their
    length. What is left are nodes where ways meet; each further round takes those all of whose predecessors are
    placed and writes only the ones that still wait. Only counts come to the driver.
    """
    e = Written(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").distinct()).df
    nodes = e.select(F.col("s").alias("node")).unionByName(e.select(F.col("d").alias("node"))).distinct()
    near = _anchors(e, nodes)
    meets = e.groupBy("d").agg(F.count(F.lit(1)).alias("waits")).where("waits > 1")
    # ways between the nodes that are left; one from a node behind a cycle is never walked, so its end waits for ever
    ways = e.join(meets.select("d"), "d", "left_semi").join(near.where("done").withColumnRenamed("node", "s"), "s").select(F.col("anchor").alias("s"), "d", (F.col("dist") + 1).alias("w"))
    ways = Written(ways.groupBy("s", "d").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))).df
    front = near.where("done and dist = 0").select(F.col("node").alias("s")).join(meets.select(F.col("d").alias("s")), "s", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    placed = [front]
    wait = meets.select("d", "waits", F.lit(None).cast("bigint").alias("level"))
    while True:
        got = ways.join(front, "s").groupBy("d").agg(F.sum("n").alias("freed"), F.max(F.col("level") + F.col("w")).alias("far"))
        step = Written(wait.join(got, "d", "left").select("d", (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits"), F.greatest("level", "far").alias("level")))
        front = step.df.where("waits = 0").select(F.col("d").alias("s"), "level")
        if not front.limit(1).count():
            break
        placed.append(front)
        wait = step.df.where("waits > 0")
    known = functools.reduce(DataFrame.unionByName, placed).select(F.col("s").alias("anchor"), "level")
    return near.join(known, "anchor", "left").select("node", F.when(F.col("done"), F.col("level") + F.col("dist")).alias("level"))


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(from_node, to_node) for every way in the graph, by joining ways of doubling length."""
    cur = Written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    n = cur.df.count()
    while True:
        l, r = cur.df, cur.df.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = Written(l.unionByName(l.join(r, "b").select("a", F.col("c").alias("b"))).distinct())
        cur.drop()
        cur, m = new, new.df.count()
        if m == n:
            return cur.df.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
        n = m


def has_cycle(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row: n_nodes, n_unplaced, acyclic."""
    lv = topo_levels(edges, src, dst)
    return lv.agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("level").isNull(), 1)).alias("n_unplaced")).withColumn("acyclic", F.col("n_unplaced") == 0)


def child_profile(nodes: DataFrame, node: str, parent: str, concept: str) -> DataFrame:
    """Each parent's children: n_children and the sorted list of their concepts."""
    kids = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("node"), F.col(concept).alias("_c"))
    return kids.groupBy("node").agg(F.count(F.lit(1)).alias("n_children"), F.sort_array(F.collect_list("_c")).alias("concepts"))


def list_similarity(q: Column, c: Column) -> Column:
    """Query items found in the candidate, repeats counted, over the query's size plus the candidate's items not in it."""
    shared = F.size(F.filter(q, lambda x: F.array_contains(c, x)))
    extra = F.size(F.filter(c, lambda y: ~F.array_contains(q, y)))
    return F.when(F.size(q) + extra == 0, 0.0).otherwise(shared / (F.size(q) + extra))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two lists as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similar_profiles(profiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of child profiles above a similarity (`list_similarity`), the first asked for by a node with `asks`.

    Columns: query_profile, profile, n_queries, n_nodes, similarity, set_similarity. Nodes of equal profile are one
    row from the start; profiles meet through the concepts they share.
    """
    c = profiles.groupBy(F.array_join("concepts", "|").alias("profile"), "concepts").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("asks"), 1)).alias("n_queries"))
    # each pair meets once, by its least common concept
    one = c.where("n_queries > 0").select(F.col("profile").alias("query_profile"), F.col("concepts").alias("qc"), "n_queries", F.explode(F.array_distinct("concepts")).alias("_c"))
    two = c.select("profile", "concepts", "n_nodes", F.explode(F.array_distinct("concepts")).alias("_c"))
    met = one.join(two, "_c").where(F.col("_c") == F.array_min(F.array_intersect("qc", "concepts")))
    s = met.withColumn("similarity", list_similarity(F.col("qc"), F.col("concepts"))).where(F.col("similarity") > threshold)
    return s.withColumn("set_similarity", set_similarity(F.col("qc"), F.col("concepts"))).drop("qc", "concepts", "_c")


def structure_hash(nodes: DataFrame, node: str, parent: str, concept: str) -> DataFrame:
    """Hash of each parent's children by concept, the same for equal structures."""
    return child_profile(nodes, node, parent, concept).select("node", F.substring(F.sha2(F.array_join("concepts", "|"), 256), 1, 16).alias("topo_hash"), "n_children")


def graph_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change) of nodes 'added', 'removed' or 'changed' in any field (null-safe); one row per key each side."""
    b = before.select(key, F.struct(*fields).alias("_b"))
    a = after.select(key, F.struct(*fields).alias("_a"))
    d = b.join(a, key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return d.select(key, change.alias("change")).where("change IS NOT NULL")


def dangling(nodes: DataFrame, edges: DataFrame, node: str, end: str) -> DataFrame:
    """Edges whose end is no node, and nodes given more than once: (kind, id, n)."""
    lost = edges.where(F.col(end).isNotNull()).join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_anti").groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    twice = nodes.groupBy(F.col(node).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lost.select(F.lit("dangling").alias("kind"), "id", "n").unionByName(twice.select(F.lit("duplicate").alias("kind"), "id", "n"))
