"""Changes between consecutive full snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import WIDTH, Dictionary, align, compare
from tessera.session import shared_dir


def snapshot_changes(df: DataFrame, date: str, delivered: str, key: str, fields: list[str], dictionary: str | None = None) -> DataFrame:
    """Rows (date, key, change, field) for each date but the first, against the date before it in the table.

    change is 'added' or 'removed' (field '') or 'changed' with one row per changed field. Of a date delivered more
    than once only the rows of the latest delivery count (null is the earliest delivery). Rows with a null key or
    date are left out; a key repeated in one delivery counts once, with the greatest field tuple. Null differs from
    every value. The list of dates is the only thing of the data that comes to the driver. Tables with fewer than two
    dates give no row.

    Keys get ordinals that persist in the folder `dictionary` (a new one in the shared folder if none is named): a
    later call with more snapshots keeps the ordinals of all keys it meets again and numbers the new ones after them.
    """
    rows = df.select(F.col(date).alias("_date"), F.col(delivered).alias("_at"), F.col(key).alias(key), *fields).where(F.col(key).isNotNull() & F.col("_date").isNotNull())
    last = {r["_date"]: r["_at"] for r in rows.groupBy("_date").agg(F.max("_at").alias("_at")).collect()}
    dates = sorted(last)
    schema = f"{date} {df.schema[date].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, change string, field string"
    if len(dates) < 2:
        return df.sparkSession.createDataFrame([], schema)
    numbers = Dictionary(df.sparkSession, dictionary or f"{shared_dir(df.sparkSession)}/tessera-ordinals-{uuid.uuid4().hex}", df.schema[key].dataType.simpleString())
    parts = []
    for at in range(0, len(dates) - 1, WIDTH - 1):
        run = dates[at : at + WIDTH]
        keep = F.lit(False)
        for d in run:
            keep = keep | ((F.col("_date") == F.lit(d)) & F.col("_at").eqNullSafe(F.lit(last[d])))
        pairs = [(i, i + 1) for i in range(len(run) - 1)]
        out = compare(numbers.extend(align(rows.where(keep), key, "_date", run, fields), key), key, pairs, fields)
        new = F.element_at(F.array(*[F.lit(d) for d in run]), F.col("pair") + 2)
        change = F.when(F.col("change") == "only_old", "removed").when(F.col("change") == "only_new", "added").otherwise("changed")
        parts.append(out.select(new.alias(date), F.col("key").alias(key), change.alias("change"), "field"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
