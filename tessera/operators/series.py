"""Time series in long form: (series key, time or position, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, t: str):
    return Window.partitionBy(key).orderBy(t)


def runs(df: DataFrame, key: str, pos: str, on: Column, min_length: int = 1) -> DataFrame:
    """Contiguous runs of true: key, region (1..n), first, last, length. Shorter runs are left out and not numbered."""
    d = df.select(key, F.col(pos).alias("_p"), on.alias("_on"))
    edge = F.when(F.col("_on") != F.coalesce(F.lag("_on").over(_w(key, "_p")), ~F.col("_on")), 1).otherwise(0)
    d = d.withColumn("_e", edge).withColumn("_run", F.sum("_e").over(_w(key, "_p").rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    r = d.groupBy(key, "_run").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= min_length)
    return r.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_run")).cast("bigint").alias("region"), "first", "last", "length")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The union of overlapping or touching intervals of each key."""
    seen = F.max(end).over(_w(key, start).rowsBetween(Window.unboundedPreceding, -1))
    d = df.select(key, start, end).where(F.col(end) >= F.col(start))
    d = d.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0))
    d = d.withColumn("_g", F.sum("_new").over(_w(key, start).rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def diff(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(_w(key, t)))


def moving_average(df: DataFrame, key: str, t: str, value: str, width: int) -> DataFrame:
    """Mean of `width` samples around each, with zeros beyond the ends (an odd width is centred)."""
    w = _w(key, t).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def moving_median(df: DataFrame, key: str, t: str, value: str, half: int) -> DataFrame:
    """Median of 2 * half + 1 samples around each; beyond the ends the end's value repeats."""
    w, whole = _w(key, t), _w(key, t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_l", F.collect_list(value).over(w.rowsBetween(-half, half)))
    d = d.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    head, tail = F.first(value).over(whole), F.last(value).over(whole)
    d = d.withColumn("_h", head).withColumn("_t", tail)
    d = d.withColumn("_l", F.concat(F.array_repeat("_h", F.greatest(F.lit(0), half + 1 - F.col("_i"))), "_l", F.array_repeat("_t", F.greatest(F.lit(0), F.col("_i") + half - F.col("_n")).cast("int"))))
    return d.withColumn("median", F.element_at(F.sort_array("_l"), half + 1)).drop("_l", "_i", "_n", "_h", "_t")


def mean_crossings(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """How often a series changes sides of its mean; at the mean counts as above."""
    d = df.select(key, t, (F.col(value) >= F.avg(value).over(Window.partitionBy(key))).alias("_up"))
    d = d.withColumn("_x", F.col("_up") != F.lag("_up").over(_w(key, t)))
    return d.groupBy(key).agg(F.sum(F.when(F.col("_x"), 1).otherwise(0)).alias("crossings"))


def event_rate(df: DataFrame, key: str, t: str, per: float = 60.0) -> DataFrame:
    """Rate between successive distinct events, at the middle between them: key, at, rate."""
    d = df.select(key, t).distinct().withColumn("_p", F.lag(t).over(_w(key, t))).where("_p IS NOT NULL")
    return d.select(key, ((F.col(t) + F.col("_p")) / 2).alias("at"), (F.lit(per) / (F.col(t) - F.col("_p"))).alias("rate"))


def reject_outlier_intervals(df: DataFrame, key: str, t: str, scale: float = 3.0) -> DataFrame:
    """Events one of whose two intervals is within scale * MAD of the median interval; the first and last stay."""
    w = _w(key, t)
    d = df.select(key, t).distinct().withColumn("_d", F.col(t) - F.lag(t).over(w))
    g = Window.partitionBy(key)
    d = d.withColumn("_m", F.percentile("_d", 0.5).over(g))
    d = d.withColumn("_mad", F.percentile(F.abs(F.col("_d") - F.col("_m")), 0.5).over(g))
    ok = F.abs(F.col("_d") - F.col("_m")) <= scale * F.col("_mad")
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(True)))
    d = d.withColumn("_next", F.coalesce(F.lead("_ok").over(w), F.lit(True)))
    return d.where("_ok OR _next").select(key, t)


def remove_jumps(df: DataFrame, key: str, t: str, value: str, scale: float = 5.0) -> DataFrame:
    """Values less the sum of the jumps so far; a jump differs from the median step by more than scale * MAD."""
    w, g = _w(key, t), Window.partitionBy(key)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_m", F.percentile("_d", 0.5).over(g))
    d = d.withColumn("_mad", F.percentile(F.abs(F.col("_d") - F.col("_m")), 0.5).over(g))
    jump = F.when(F.abs(F.col("_d") - F.col("_m")) > scale * F.col("_mad"), F.col("_d")).otherwise(0.0)
    d = d.withColumn("_j", F.coalesce(jump, F.lit(0.0)))
    return d.withColumn("smooth", F.col(value) - F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_m", "_mad", "_j")


def quality_blocks(df: DataFrame, key: str, pos: str, value: str, size: int, min_kurtosis: float = 1.5) -> DataFrame:
    """Blocks of `size` samples: block, n, good. A block is bad if it is flat or its excess kurtosis is too small; a
    block of under 4 samples is good."""
    b = df.groupBy(key, F.expr(f"CAST({pos} AS BIGINT) div {size}").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.kurtosis(value).alias("_k"), F.stddev_pop(value).alias("_s"))
    return b.select(key, "block", "n", F.when(F.col("n") < 4, True).otherwise((F.col("_s") >= 1e-10) & (F.coalesce("_k", F.lit(0.0)) >= min_kurtosis)).alias("good"))


def normalize_max(df: DataFrame, key: str, value: str) -> DataFrame:
    top = F.max(value).over(Window.partitionBy(key))
    return df.withColumn("norm", F.when(top > 0, F.col(value) / top).otherwise(0.0))


def normalize_quantile(df: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """Values over the series' exact quantile (linear interpolation), clipped to [0, 1]."""
    top = F.percentile(value, q).over(Window.partitionBy(key))
    return df.withColumn("norm", F.when(top > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) / top))).otherwise(0.0))


def mask(df: DataFrame, regions: DataFrame, key: str, t: str, start: str, end: str, before: float = 0.0, after: float = 0.0, exclude: bool = False) -> DataFrame:
    """Samples inside (or outside) the regions [start - before, end + after).

    Regions are merged per key first, so each sample meets at most one: both are read in time order, without pairs.
    """
    r = merge_intervals(regions.select(key, (F.col(start) - before).alias("_s"), (F.col(end) + after).alias("_e")), key, "_s", "_e")
    cols = [c for c in df.columns if c != key]
    a = df.select(key, F.col(t).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_e"), F.struct(*cols).alias("_row"))
    b = r.select(key, F.col("_s").alias("_t"), F.lit(0).alias("_k"), F.col("_e").cast("double"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumn("_end", F.last("_e", ignorenulls=True).over(w)).where("_k = 1")
    inside = F.coalesce(F.col("_t") < F.col("_end"), F.lit(False))
    return d.where(~inside if exclude else inside).select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def merge_by_first_time(sources: list[DataFrame], key: str, t: str) -> DataFrame:
    """Sources one after another in the order of their first time, with ordinal `seq` per key."""
    parts = [s.select(key, t, *[c for c in s.columns if c not in (key, t)], F.lit(i).alias("_src")) for i, s in enumerate(sources)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    first = F.min(t).over(Window.partitionBy(key, "_src"))
    d = d.withColumn("_first", first)
    return d.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("_first", "_src", t)).cast("bigint")).drop("_src", "_first")


def resample(df: DataFrame, key: str, t: str, value: str, step: float, method: str = "linear") -> DataFrame:
    """Values on the grid from each series' first time in steps of `step`: key, t, value ('linear' or 'nearest').

    The grid is united with the samples and each point takes the sample before and after it in time order. Ties of
    'nearest' take the later one.
    """
    s = df.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = s.select(key, F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - F.col("_a")) / step).cast("int"))).alias("_i"), "_a").select(key, (F.col("_a") + F.col("_i") * step).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_g"))
    a = df.groupBy(key, F.col(t).alias("_t")).agg(F.avg(value).alias("_v")).withColumn("_g", F.lit(0))
    d = a.select(key, "_t", "_v", "_g").unionByName(grid)
    point = F.when(F.col("_g") == 0, F.struct("_t", "_v"))
    back, ahead = Window.partitionBy(key).orderBy("_t", "_g").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(F.col("_t"), F.col("_g")).rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_n", F.first(point, ignorenulls=True).over(ahead)).where("_g = 1")
    t0, v0, t1, v1 = F.col("_p._t"), F.col("_p._v"), F.col("_n._t"), F.col("_n._v")
    if method == "nearest":
        v = F.when(F.col("_n").isNull() | (F.col("_t") - t0 < t1 - F.col("_t")), v0).otherwise(v1)
        v = F.when(F.col("_t") == t0, v0).otherwise(v)
    else:
        v = F.when(F.col("_n").isNull() | (F.col("_t") == t0), v0).otherwise(v0 + (v1 - v0) * (F.col("_t") - t0) / (t1 - t0))
    return d.select(key, F.col("_t").alias(t), v.alias(value))


def pad(onsets: DataFrame, anchor: DataFrame, key: str, t: str, value: str, width: float, kernel: str = "constant") -> DataFrame:
    """Each anchor time with the sum of onset * kernel over the onsets in (t - width, t].

    'linear' falls from 1 to 0 over the width, 'exponential' to 0.01, 'gaussian' by half a bell with a deviation of
    2 sqrt(width) sixtieths of the width. Times are put into buckets of the width, so an
    onset meets only the anchors of two buckets.
    """
    o = onsets.select(key, F.col(t).alias("_o"), F.col(value).alias("_v"))
    o = o.withColumn("_bk", F.explode(F.array(F.floor(F.col("_o") / width), F.floor(F.col("_o") / width) + 1)))
    a = anchor.select(key, F.col(t).alias("_t")).distinct().withColumn("_bk", F.floor(F.col("_t") / width))
    age = (F.col("_t") - F.col("_o")) / width
    k = {"constant": F.lit(1.0), "linear": 1.0 - age, "exponential": F.exp(age * F.log(F.lit(0.01))), "gaussian": F.exp(-0.5 * F.pow(age * 30 / width**0.5, F.lit(2)))}[kernel]
    hit = a.join(o, [key, "_bk"]).where((age >= 0) & (age < 1)).groupBy(key, "_t").agg(F.sum(F.col("_v") * k).alias("padded"))
    return a.select(key, "_t").join(hit, [key, "_t"], "left").select(key, F.col("_t").alias(t), F.coalesce("padded", F.lit(0.0)).alias("padded"))


def hours_covered(intervals: DataFrame, key: str, start: str, end: str, around: float = 0.0) -> DataFrame:
    """Hours under the union of intervals in seconds, each widened by `around` on both sides."""
    m = merge_intervals(intervals.select(key, (F.col(start) - around).alias("_s"), (F.col(end) + around).alias("_e")), key, "_s", "_e")
    return m.groupBy(key).agg((F.sum(F.col("_e") - F.col("_s")) / 3600.0).alias("hours"))


def hop_windows(df: DataFrame, key: str, pos: str, value: str, size: int, hop: int) -> DataFrame:
    """Full windows of `size` samples every `hop`: key, window, mean. Partial windows at the end give no row."""
    last = F.max(pos).over(Window.partitionBy(key))
    d = df.withColumn("_n", last + 1)
    first = F.greatest(F.lit(0), F.expr(f"CAST(ceil(({pos} - {size} + 1) / {float(hop)}) AS BIGINT)"))
    top = F.least(F.expr(f"CAST({pos} AS BIGINT) div {hop}"), F.expr(f"CAST(_n - {size} AS BIGINT) div {hop}"))
    d = d.where(F.col("_n") >= size).withColumn("_f", first).withColumn("_l", top).where("_l >= _f")
    return d.withColumn("window", F.explode(F.sequence("_f", "_l"))).groupBy(key, "window").agg(F.avg(value).alias("mean"))
