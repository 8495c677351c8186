"""Catalog shapes beyond joins: tiered matching, expectations, JSON members, version traces, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered_match(left: DataFrame, right: DataFrame, key: str, target: str, tiers: list) -> DataFrame:
    """(key, tier, target, n): each distinct left key with its match in the first tier that has one.

    A tier is a function of a column; a match is equality of what it makes of both. n is the number of matches in that
    tier; target is null where it is ambiguous (n > 1), and tier is null where no tier matches. The right side is
    grouped by each tier's value first, so equal values never multiply.
    """
    keys = left.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    names = right.select(F.col(target).alias("t")).where("t IS NOT NULL").distinct()
    parts = []
    for i, f in enumerate(tiers):
        by = names.groupBy(f(F.col("t")).alias("v")).agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
        parts.append(keys.select("k", f(F.col("k")).alias("v")).join(by, "v").select("k", F.lit(i).alias("i"), "t", "n"))
    best = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.min(F.struct("i", "t", "n")).alias("b"))
    out = keys.join(best, "k", "left")
    return out.select(F.col("k").alias(key), F.col("b.i").cast("bigint").alias("tier"), F.when(F.col("b.n") == 1, F.col("b.t")).alias("target"), F.coalesce("b.n", F.lit(0)).alias("n"))


def expectations(df: DataFrame, key: str, rules: dict[str, Column], unique: bool = True) -> DataFrame:
    """(rule, n) of broken rules, in one pass, and of keys given more than once ('duplicate'). A rule that is null for
    a row is not broken by it."""
    broken = F.array(*[F.when(~r, F.lit(n)) for n, r in rules.items()])
    out = df.select(F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    if unique:
        twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out = out.unionByName(twice.select(F.lit("duplicate").alias("rule"), "n"))
    return out


def json_members(c: Column) -> Column:
    """The number of keys of a JSON object or of elements of a list; 0 for null, other values and broken text."""
    return F.coalesce(F.size(F.json_object_keys(c)), F.json_array_length(c), F.lit(0))


def json_contains(c: Column, name: str) -> Column:
    """Whether a JSON object has the key, or a list the string or an object named so ('fqdn' or 'atom_fqdn')."""
    items = F.from_json(c, "array<string>")
    as_item = F.exists(items, lambda x: (x == name) | (F.get_json_object(x, "$.fqdn") == name) | (F.get_json_object(x, "$.atom_fqdn") == name))
    return F.coalesce(F.array_contains(F.json_object_keys(c), name), as_item, F.lit(False))


def version_trace(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each row with its place in its key's order and the fields that differ from the row before ('' for the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.array(*[F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields])
    names = F.array_join(F.filter(changed, lambda x: x.isNotNull()), ",")
    return df.withColumn("step", F.row_number().over(w).cast("bigint")).withColumn("changed", F.when(F.col("step") == 1, "").otherwise(names))


def supersedes(old: DataFrame, new: DataFrame, key: str, on: list[str], value: str, margin: float = 0.05) -> DataFrame:
    """(key, n_shared, better): whether new values are less than old ones by the margin on all shared measures.

    Old values of 0 are left out; keys without a shared measure give no row.
    """
    o = old.select(key, *on, F.col(value).alias("_o")).where("_o <> 0")
    j = o.join(new.select(key, *on, F.col(value).alias("_n")), [key, *on])
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("n_shared"), F.bool_and((F.col("_o") - F.col("_n")) / F.abs("_o") >= margin).alias("better"))


def stability(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The share of repeated groups whose value is always the same: n_groups, stable_share."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(value).alias("_d")).where("_n > 1")
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.avg((F.col("_d") <= 1).cast("int")).alias("stable_share"))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's most frequent value, the least on ties."""
    n = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return w.select(group, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def histogram(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Counts in equal bins over each group's range, the last bin closed: group, bin, n. Flat groups have bin 0."""
    r = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(0))
    return df.where(F.col(value).isNotNull()).join(r, group).groupBy(group, F.least(at, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def smallest_prime(c: Column, n_primes: int = 100) -> Column:
    """The least of the first primes that divides a number and is smaller than it, 0 if none; a number below 2 itself."""
    primes: list[int] = []
    x = 2
    while len(primes) < n_primes:
        if all(x % p for p in primes if p * p <= x):
            primes.append(x)
        x += 1
    return F.when(c < 2, c).otherwise(F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, primes)), lambda p: (p < c) & (c % p == 0))), F.lit(0)))


def midpoint(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Whether lo + hi passes the largest 64-bit integer, and the midpoint taken without it. lo is not above hi."""
    top = F.lit((1 << 63) - 1)
    return (lo > 0) & (hi > top - F.greatest(lo, F.lit(0))), lo + F.shiftright(hi - lo, 1)


def alphabet(df: DataFrame, group: str, text: str, pattern: list[str]) -> DataFrame:
    """group, symbols (distinct characters of all its texts), shared (those of the pattern among them).

    A character is a code point, whatever its script. Distinct symbols of each text come first, so what is shuffled is
    small. A group without any character has no row.
    """
    c = df.select(group, F.explode(F.array_distinct(F.split(text, ""))).alias("c")).where("c <> ''")
    return c.groupBy(group).agg(F.countDistinct("c").alias("symbols"), F.countDistinct(F.when(F.col("c").isin(pattern), F.col("c"))).alias("shared"))
