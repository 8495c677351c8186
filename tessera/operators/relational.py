"""Relational shapes of a catalog: latest rows, lateral picks, semi and anti joins, documents, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Written


def latest_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in `order` (one row per key; ties are decided by the order given, so make it total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_row(df: DataFrame, keys: list[str], rank: list[str], take: list[str]) -> DataFrame:
    """Like `latest_per_group` for the greatest `rank`, as an aggregate: combined before the shuffle, safe for hot keys."""
    best = F.max(F.struct(*rank, *[c for c in take if c not in rank])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in take])


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank. Spark cuts each task's group at k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def lateral_top1(left: DataFrame, right: DataFrame, key: str, rank: list[str], take: list[str]) -> DataFrame:
    """Each left row with the best right row of its key, or nulls."""
    return left.join(best_row(right, [key], rank, take), key, "left")


def semi_all(df: DataFrame, tests: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key is found in every one of the tables."""
    return reduce(lambda d, t: d.join(t[0].select(t[1]).distinct(), t[1], "left_semi"), tests, df)


def missing_or_stale(df: DataFrame, derived: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows without a derived row, or whose derived row differs in `compare`, null-safe; with the reason."""
    d = derived.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_d_{c}") for c in compare])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in compare])
    out = df.join(d, key, "left").withColumn("reason", F.when(F.col("_there").isNull(), "missing").when(~same, "stale"))
    return out.where(F.col("reason").isNotNull()).drop("_there", *[f"_d_{c}" for c in compare])


def union_by_precedence(sources: list[tuple[DataFrame, int]], key: str, value: str) -> DataFrame:
    """UNION ALL of sources; each key takes the value of its source of highest precedence (then the greatest value)."""
    parts = [d.select(key, F.lit(p).alias("_p"), value) for d, p in sources]
    return best_row(reduce(DataFrame.unionByName, parts), [key], ["_p", value], [value])


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of ordered rows with the total count; the count is an aggregate, not a window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))  # one row
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def nested_children(child: DataFrame, key: str, order: list[str], take: list[str], name: str) -> DataFrame:
    """Each key's child rows as one ordered array of structs."""
    item = F.struct(*order, *[c for c in take if c not in order])
    return child.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_l")).select(key, F.transform("_l", lambda s: F.struct(*[s[c].alias(c) for c in take])).alias(name))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """The same aggregates under several groupings; columns out of a grouping are null, `grouping_id` tells which."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("grouping_id"), *aggs)


def upsert(current: DataFrame, changes: DataFrame, key: str, stamp: str) -> DataFrame:
    """Last writer wins by key: the row of the greatest stamp from either table; `changes` wins ties."""
    cols = [c for c in current.columns if c not in (key, stamp)]
    both = current.select(key, stamp, F.lit(0).alias("_w"), *cols).unionByName(changes.select(key, stamp, F.lit(1).alias("_w"), *cols))
    return best_row(both, [key], [stamp, "_w"], [stamp, *cols])


def keep_last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Retention: the last n rows of each group."""
    return top_k_per_group(df, keys, order, n).drop("rank")


def pareto_front(df: DataFrame, key: str, a: str, b: str, parts: int = 64) -> DataFrame:
    """Rows that no other row beats: as great in a and b and greater in one. Null counts as the least.

    A row is beaten if its b isn't above the greatest b of the rows with a greater a, or is below that of its own a.
    Rows are ranged by a into parts; the greatest b of each part (as many rows as parts) goes to all later ones, so
    that no task sees more than a part, however large the front is.
    """
    low = F.lit(float("-inf"))
    d = df.select(key, F.coalesce(a, low).alias("_a"), F.coalesce(b, low).alias("_b"))
    # written once, so the parts stay the same
    ranged = Written(d.groupBy("_a").agg(F.max("_b").alias("_top")).repartitionByRange(parts, F.col("_a").desc()).withColumn("_p", F.spark_partition_id())).df
    before = ranged.groupBy("_p").agg(F.max("_top").alias("_m")).withColumn("_before", F.max("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_before")
    inner = F.max("_top").over(Window.partitionBy("_p").orderBy(F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, -1))
    seen = F.greatest("_before", "_inner")
    good = ranged.withColumn("_inner", inner).join(F.broadcast(before), "_p").where(seen.isNull() | (F.col("_top") > seen)).select("_a", F.col("_top").alias("_b"))
    return d.join(good, ["_a", "_b"], "left_semi").select(key, F.col("_a").alias(a), F.col("_b").alias(b))


def h_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """The largest h for each key such that h of its values are at least h."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc())
    return df.withColumn("_rn", F.row_number().over(w)).groupBy(key).agg(F.max(F.when(F.col(value) >= F.col("_rn"), F.col("_rn")).otherwise(0)).cast("bigint").alias("h_index"))


def hash_split(key: Column, salt: Column, parts: int = 5) -> Column:
    """The part of a key: SHA-256 of 'salt:key' as a number modulo 5, by the digit sum (16 leaves 1 modulo 5)."""
    hexed = F.sha2(F.concat_ws(":", salt, key), 256)
    digits = F.transform(F.split(hexed, ""), lambda c: F.when(c == "", 0).otherwise(F.conv(c, 16, 10).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda s, v: s + v) % parts


def ucb1(df: DataFrame, slot: str, arm: str, reward: str, weight: float = 1.414) -> DataFrame:
    """Upper confidence bound of each arm in its slot: mean reward + weight * sqrt(ln(pulls of the slot) / pulls)."""
    per = df.groupBy(slot, arm).agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward).alias("mean"))
    n = F.sum("pulls").over(Window.partitionBy(slot))
    return per.withColumn("ucb", F.col("mean") + weight * F.sqrt(F.log(n.cast("double")) / F.col("pulls")))


def best_so_far(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The least value up to each row of its group, and whether the row improved it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best", F.least(F.coalesce(before, F.col(value)), F.col(value))).withColumn("improved", F.coalesce(F.col(value) < before, F.lit(True)))


def min_max_reward(value: Column, best: Column, worst: Column) -> Column:
    """How near a value is to the best known: 1 at it, 0 at the worst, clamped; 0 where both are equal."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((worst - value) / F.nullif(worst - best, F.lit(0.0)), F.lit(0.0))))


def share_of_total(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each row's percentage of its group's total; 0 where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn("share", F.coalesce(F.col(value) / F.nullif(total, F.lit(0.0)) * 100, F.lit(0.0)))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, take: str) -> DataFrame:
    """Each left row with the right value of its key at or before its time, null if none.

    Both are united and read in time order, so there is one shuffle by key and no pairs. On equal times the right
    row comes first.
    """
    cols = [c for c in left.columns if c != key]
    a = left.select(key, F.col(left_t).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(right.schema[take].dataType).alias("_v"), F.struct(*cols).alias("_l"))
    b = right.select(key, F.col(right_t).alias("_t"), F.lit(0).alias("_s"), F.col(take).alias("_v"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    w = Window.partitionBy(key).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    return out.select(key, *[F.col(f"_l.{c}").alias(c) for c in cols], F.col("_v").alias(take))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Points with the half-open ranges [start, end) that hold them: an equi-join on buckets of `width`, then the test."""
    on = on or []
    p = points.withColumn("_bk", F.floor(F.col(point) / width))
    r = ranges.where(F.col(end) > F.col(start)).withColumn("_bk", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(r, [*on, "_bk"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bk")
