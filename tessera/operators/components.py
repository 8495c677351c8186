"""Connected components of an undirected graph, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Written


def _star(e: DataFrame, small: bool) -> DataFrame:
    """Every vertex sends its neighbours (small: those below it) to the least of them and itself."""
    if small:
        nb = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        nb = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = nb.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
    got = nb.join(least, "u")
    out = got.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if not small else got.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each vertex of an edge; component is the least vertex of its component.

    Null ends and loops are left out, repeated edges count once. The number of rounds grows with the square of the
    logarithm of the largest component at most; each round's edges are written to the shared folder, and only their
    number and a checksum come to the driver. A vertex with very many edges is combined before each shuffle, and the
    join back to its edges is one the adaptive planner splits.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    cur, last = Written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        new = Written(_star(_star(cur.df, small=False), small=True))
        cur.drop()
        cur = new
        r = cur.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == last or r["n"] == 0:
            break
        last = (r["n"], r["h"])
    # at the end every edge leads from a node to its component's least
    nodes = cur.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(cur.df.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
