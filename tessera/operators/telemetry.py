"""Event lists, progress, counters, flow comparisons, admission rules and credit shares of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows from offset on in an order; the planner keeps offset + limit rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, keys: list[str], at: list[str], fields: list[str]) -> DataFrame:
    """The last row's fields of each key; combined before the shuffle, so a hot key is one row per task."""
    return df.groupBy(*keys).agg(F.max(F.struct(*at, *fields)).alias("_l")).select(*keys, *[f"_l.{f}" for f in fields])


def share_of_total(df: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Each row's share (in per cent) of its group's sum; 0 where the sum is."""
    v = df.withColumn("_v", value)
    total = v.groupBy(*group).agg(F.sum("_v").alias("_t"))
    return v.join(total, group).withColumn(name, F.when(F.col("_t") != 0, 100 * F.col("_v") / F.col("_t")).otherwise(0.0)).drop("_v", "_t")


def path_check(runs: DataFrame, variant: str, path: str, expected: dict[str, str]) -> DataFrame:
    """(variant, paths, ok): each variant must show just its one expected path."""
    want = F.create_map(*[F.lit(x) for p in expected.items() for x in p])
    g = runs.groupBy(variant).agg(F.sort_array(F.collect_set(path)).alias("_p"))
    return g.select(variant, F.array_join("_p", ",").alias("paths"), (F.col("_p") == F.array(F.try_element_at(want, F.col(variant)))).alias("ok"))


def ordered_means(df: DataFrame, variant: str, value: str, order: list[str]) -> DataFrame:
    """(variant, mean, violates): means rounded to 3 places must not fall in the given order of variants."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(variant))
    g = df.where(F.col(variant).isin(order)).groupBy(variant).agg(F.round(F.avg(value), 3).alias("mean"))
    # as many rows as variants are named
    return g.withColumn("violates", F.coalesce(F.col("mean") < F.lag("mean").over(Window.orderBy(place)), F.lit(False)))


def deltas(df: DataFrame, variant: str, base: str, metrics: list[str]) -> DataFrame:
    """(variant, d_<metric>): each other variant's means less those of the base one, rounded to 4 places."""
    g = df.groupBy(variant).agg(*[F.avg(m).alias(m) for m in metrics])
    b = g.where(F.col(variant) == base).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    return g.where(F.col(variant) != base).join(F.broadcast(b)).select(variant, *[F.round(F.col(m) - F.col(f"_{m}"), 4).alias(f"d_{m}") for m in metrics])  # the base is one row


def too_few(df: DataFrame, count: str, seconds: str, per_minute: float) -> DataFrame:
    """Rows with fewer than so many a minute; rows without a count or a duration above 0 pass silently."""
    return df.where((F.col(seconds) > 0) & (F.col(count) / (F.col(seconds) / 60) < per_minute))


def missing_keys(df: DataFrame, keys: Column, required: list[str]) -> DataFrame:
    """Rows that lack required keys, with the list of these."""
    return df.withColumn("missing", F.sort_array(F.array_except(F.array(*map(F.lit, required)), keys))).where(F.size("missing") > 0)
