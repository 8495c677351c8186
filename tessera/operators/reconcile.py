"""Differences between two copies of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import align, compare


def diff_copies(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, kind, field): 'missing_in_right', 'missing_in_left' (field '') or 'differs' with the field's name.

    Both sides hold `key` and `fields` of equal types; other columns are not read. A null key is no record and is
    left out; equal keys of one side count once, with the greatest field tuple. Null equals only null: callers map
    null where it means the same as another value. An empty side makes every key of the other missing in it.
    """
    tag = lambda df, side: df.select(key, F.lit(side).alias("_side"), *fields)
    rows = tag(left, 0).unionByName(tag(right, 1)).where(F.col(key).isNotNull())
    out = compare(align(rows, key, "_side", [0, 1], fields), key, [(0, 1)], fields)
    kind = F.when(F.col("change") == "only_old", "missing_in_right").when(F.col("change") == "only_new", "missing_in_left").otherwise("differs")
    return out.select(F.col("key").alias(key), kind.alias("kind"), "field")
