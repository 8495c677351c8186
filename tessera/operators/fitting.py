"""Law fitting over numeric tables, and evaluation of predictions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def participation_ratio(df: DataFrame, cols: list[str], log: bool = False) -> DataFrame:
    """(trace C)^2 / ||C||^2 of the correlation matrix: 1 row, pr. One aggregate pass, no eigenvalues.

    With log, columns are taken as logarithms and rows with a value not above 0 are left out.
    """
    if log:
        for c in cols:
            df = df.where(F.col(c) > 0)
        df = df.select(*[F.log(c).alias(c) for c in cols])
    pairs = [F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(combinations(cols, 2))]
    k = len(cols)
    squares = sum((F.pow(F.col(f"_{i}"), 2) for i in range(len(pairs))), F.lit(0.0))
    return df.agg(*pairs).select((F.lit(float(k * k)) / (k + 2 * squares)).alias("pr"))


def invariant_variation(df: DataFrame, forms: dict[str, str]) -> DataFrame:
    """For each named expression: constant (mean) and cv = deviation / |mean|, by one pass: name, constant, cv."""
    parts = [F.struct(F.lit(n).alias("name"), F.avg(F.expr(e)).alias("constant"), (F.stddev_pop(F.expr(e)) / F.nullif(F.abs(F.avg(F.expr(e))), F.lit(0.0))).alias("cv")) for n, e in forms.items()]
    return df.agg(F.array(*parts).alias("_a")).select(F.inline("_a"))


def direct_residual(df: DataFrame, left: str, right: str, least_rows: int = 10) -> DataFrame:
    """Median of |l - r| / max(|l|, |r|) over finite rows; null for too few rows: n, residual."""
    l, r = F.expr(left).cast("double"), F.expr(right).cast("double")
    d = df.select(l.alias("l"), r.alias("r")).where("l IS NOT NULL AND r IS NOT NULL AND NOT isnan(l) AND NOT isnan(r)")
    e = F.abs(F.col("l") - F.col("r")) / F.nullif(F.greatest(F.abs("l"), F.abs("r")), F.lit(0.0))
    return exact_median(d.select(F.coalesce(e, F.lit(0.0)).alias("v")), "v").select("n", F.when(F.col("n") >= least_rows, F.col("median")).alias("residual"))


def exact_median(df: DataFrame, value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median of a double column without nulls, NaN being greatest: 1 row, n, median.

    Three scans: a sketch gives two bounds close around the middle, then exact counts tell on which side of them the
    middle ranks lie, then the distinct values there, some 4 n / accuracy, are put in order by one task. The sketch
    decides only how many are ordered, not the result.
    """
    d, v = df.select(F.col(value).alias("v")), F.col("v")
    shares = F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy))
    bounds = d.agg(F.percentile_approx(F.when(~F.isnan(v), v), shares, F.lit(accuracy)).alias("b")).select(F.coalesce(F.col("b")[0], F.lit(0.0)).alias("lo"), F.coalesce(F.col("b")[1], F.lit(0.0)).alias("hi"))
    below, upto = F.count_if(v < F.col("lo")), F.count_if(v <= F.col("hi"))
    at = d.crossJoin(F.broadcast(bounds)).agg(F.count(F.lit(1)).alias("n"), below.alias("below"), upto.alias("upto"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))  # one row
    at = at.select("*", F.expr("(n - 1) div 2").alias("r0"), F.expr("n div 2").alias("r1"))
    near = d.crossJoin(F.broadcast(at)).where("CASE WHEN v < lo THEN r0 < below WHEN v <= hi THEN r0 < upto AND r1 >= below ELSE r1 >= upto END")
    counts = near.groupBy("v").agg(F.count(F.lit(1)).alias("c"), *[F.max(x).alias(x) for x in ("n", "r0", "r1", "below", "upto")])
    # rows up to each value, with those left out before the first
    before = F.expr("CASE WHEN r0 < below THEN 0 WHEN r0 < upto THEN below ELSE upto END")
    to = counts.withColumn("to", before + F.sum("c").over(Window.orderBy("v")))
    middle = to.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min(F.expr("CASE WHEN to > r0 THEN v END")).alias("a"), F.min(F.expr("CASE WHEN to > r1 THEN v END")).alias("b"))
    return middle.select("n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"))


def ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, low, high) of each column, in one pass."""
    return df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")) for c in cols]).alias("_a")).select(F.inline("_a"))


def power_law_exponents(df: DataFrame, cols: list[str]) -> np.ndarray | None:
    """Exponents of the law prod(x ** e) = const that log data fit best, largest 1; None if they fit none.

    The covariance matrix is one aggregate pass; only it comes to the driver (columns squared numbers).
    """
    for c in cols:
        df = df.where(F.col(c) > 0)
    logs = df.select(*[F.log(c).alias(c) for c in cols])
    row = logs.agg(*[F.covar_pop(a, b) for a in cols for b in cols]).first()
    c = np.array(row, dtype=float).reshape(len(cols), len(cols))
    values, vectors = np.linalg.eigh(c)
    if values[-1] <= 0 or np.sqrt(max(values[0], 0.0) / values[-1]) > 0.1:
        return None
    v = vectors[:, 0]
    return v / v[np.argmax(np.abs(v))]


def ransac_line(df: DataFrame, group: str, x: str, y: str, rounds: int = 20, holdout: int = 50, seed: int = 42) -> DataFrame:
    """A line y = a + b x for each group from seeded random pairs: group, a, b, residual (median relative, on the
    held-out rows). Groups are those of `group`; one is read by one task."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[x]) & np.isfinite(pdf[y])].sort_values([x, y])
        if len(pdf) < 10:
            return pd.DataFrame({group: pd.Series(dtype=object), "a": [], "b": [], "residual": []})
        r = np.random.default_rng(seed)
        xs, ys = pdf[x].to_numpy(), pdf[y].to_numpy()
        best = (np.inf, 0.0, 0.0)
        for _ in range(rounds):
            i = r.choice(len(xs), 2, replace=False)
            if xs[i[0]] == xs[i[1]]:
                continue
            b = (ys[i[1]] - ys[i[0]]) / (xs[i[1]] - xs[i[0]])
            a = ys[i[0]] - b * xs[i[0]]
            h = r.choice(len(xs), min(holdout, len(xs)), replace=False)
            e = np.median(np.abs(a + b * xs[h] - ys[h]) / np.maximum(np.maximum(np.abs(ys[h]), np.abs(a + b * xs[h])), 1e-300))
            best = min(best, (e, a, b))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "a": [best[1]], "b": [best[2]], "residual": [best[0]]})

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).groupBy(group).applyInPandas(fit, f"{group} {kind}, a double, b double, residual double")


def regression_losses(df: DataFrame, group: list[str], predicted: str, actual: str) -> DataFrame:
    """mse, rmse, mae of each group, over rows where both values are there."""
    e = F.col(predicted) - F.col(actual)
    return df.where(e.isNotNull()).groupBy(*group).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def binary_losses(df: DataFrame, group: list[str], p: str, label: str, clip: float = 1e-12) -> DataFrame:
    """log_loss, brier, accuracy and error of probabilities against 0/1 labels."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    y = F.col(label).cast("double")
    hit = F.when((F.col(p) >= 0.5).cast("double") == y, 1.0).otherwise(0.0)
    return df.groupBy(*group).agg((-F.avg(y * F.log(q) + (1 - y) * F.log1p(-q))).alias("log_loss"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(hit).alias("accuracy"), (1 - F.avg(hit)).alias("error"))


def align(prediction: DataFrame, reference: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Predictions inside the reference's time range with the reference interpolated to their time: key, t,
    predicted, reference. Both are read in time order, one shuffle by key. Of equal reference times the least value
    counts."""
    ref = reference.groupBy(key, F.col(t).alias("_t")).agg(F.min(value).alias("_v")).withColumn("_k", F.lit(0))
    pre = prediction.select(key, F.col(t).alias("_t"), F.col(value).alias("_v"), F.lit(1).alias("_k"))
    d = ref.select(key, "_t", "_v", "_k").unionByName(pre)
    w = Window.partitionBy(key).orderBy("_t", "_k")
    point = F.when(F.col("_k") == 0, F.struct("_t", "_v"))
    d = d.withColumn("_p", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_n", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_k = 1 AND _p IS NOT NULL")
    same = F.col("_p._t") == F.col("_t")
    d = d.where(F.col("_n").isNotNull() | same)
    v = F.when(same, F.col("_p._v")).otherwise(F.col("_p._v") + (F.col("_n._v") - F.col("_p._v")) * (F.col("_t") - F.col("_p._t")) / (F.col("_n._t") - F.col("_p._t")))
    return d.select(key, F.col("_t").alias(t), F.col("_v").alias("predicted"), v.alias("reference"))


def log_log_slope(x: Column, y: Column) -> Column:
    return F.regr_slope(F.log(y), F.log(x))
