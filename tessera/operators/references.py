"""References to records that do not exist, are gone, or come later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts a key's referring rows are split into for the join back, so that a key which holds a third of all rows
#: isn't one task.
SALT = 16


@dataclass
class Child:
    """A referring table: its name, row key, reference (normalised, null for none), load time and parent table."""

    name: str
    df: DataFrame
    row_key: Column
    ref: Column
    loaded: Column
    parent: str


@dataclass
class Parent:
    """A table referred to. A gone parent held the key once; it has no load time."""

    name: str
    df: DataFrame
    key: Column
    loaded: Column | None = None
    gone: bool = False


def _tagged(children: list[Child], parents: list[Parent]) -> DataFrame:
    parts = [
        c.df.select(F.lit(c.parent).alias("ptable"), c.ref.alias("key"), F.lit(False).alias("here"), F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("since"), c.loaded.cast("timestamp_ntz").alias("first_ref"))
        for c in children
    ] + [
        p.df.select(
            F.lit(p.name).alias("ptable"), p.key.alias("key"), F.lit(not p.gone).alias("here"), F.lit(p.gone).alias("gone"),
            (p.loaded if p.loaded is not None else F.lit(None)).cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("first_ref"),
        )
        for p in parents
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("key").isNotNull())


def orphan_keys(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Keys that lack a parent when referred to: ptable, key, kind ('missing', 'removed' or maybe 'late'), since.

    Tagged parent and child keys are united in long form and grouped by parent table and key. Groups without a
    parent flag stay, and those whose first reference comes before the parent's load. The grouping is combined
    before the shuffle, so a key shared by a third of all rows moves as one row per task.
    """
    g = _tagged(children, parents).groupBy("ptable", "key").agg(
        F.max("here").alias("here"), F.max("gone").alias("gone"), F.min("since").alias("since"), F.min("first_ref").alias("first_ref"),
        F.max(~F.col("here") & ~F.col("gone")).alias("referred"),
    )
    kind = F.when(F.col("here"), "late").when(F.col("gone"), "removed").otherwise("missing")
    return g.where(F.col("referred") & (~F.col("here") | (F.col("first_ref") < F.col("since")))).select("ptable", "key", kind.alias("kind"), "since")


def orphan_rows(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Referring rows without a parent: src_table, row_key, kind, loaded (the row's earliest load).

    A row delivered more than once counts once, at its earliest load. A null reference is no case; a row with a null
    load time is never late. Rows with a null row_key are left out.
    """
    refs = None
    for c in children:
        part = c.df.select(F.lit(c.name).alias("src_table"), F.lit(c.parent).alias("ptable"), c.row_key.alias("row_key"), c.ref.alias("key"), c.loaded.cast("timestamp_ntz").alias("loaded"))
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.where(F.col("key").isNotNull() & F.col("row_key").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(SALT)))
    bad = orphan_keys(children, parents).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("_salt", F.col("_salt").cast("bigint"))
    hit = refs.join(bad, ["ptable", "key", "_salt"]).groupBy("src_table", "row_key").agg(F.min("loaded").alias("loaded"), F.max("kind").alias("kind"), F.min("since").alias("since"))
    return hit.where((F.col("kind") != "late") | (F.col("loaded") < F.col("since"))).select("src_table", "row_key", "kind", "loaded")


def orphan_counts(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Orphan rows by referring table, kind and month: src_table, kind, period ('YYYY-MM'), n."""
    return orphan_rows(children, parents).groupBy("src_table", "kind", F.date_format("loaded", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
