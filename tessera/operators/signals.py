"""Signal kernels that need a whole series in order: filters, peaks, wavelets, convolution, recurrences.

Each runs once per series in an Arrow-batched group, on NumPy arrays; a series is the unit of work, so one must fit
an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butter_sos(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass, by the bilinear transform."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * bw / 2
    root = np.sqrt(half * half - w0 * w0)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    up = sorted(z[z.imag > 0], key=lambda p: -abs(p))
    sos = np.array([[1, 0, -1, 1, -2 * p.real, abs(p) ** 2] for p in up])
    mid = np.exp(2j * np.pi * np.sqrt(low * high) / fs)
    gain = np.prod([(1 - mid**-2) / (1 + s[4] / mid + s[5] / mid**2) for s in sos])
    sos[0, :3] /= abs(gain)
    return sos


def sos_filter(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    for b0, b1, b2, _, a1, a2 in sos:
        y = np.empty_like(x)
        z1 = z2 = 0.0
        for i, v in enumerate(x):
            y[i] = b0 * v + z1
            z1 = b1 * v - a1 * y[i] + z2
            z2 = b2 * v - a2 * y[i]
        x = y
    return x


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filtered forth and back, with odd extension at both ends."""
    n = min(3 * (2 * len(sos) + 1), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
    y = sos_filter(sos, sos_filter(sos, ext.astype(float))[::-1])[::-1]
    return y[n : len(y) - n] if n > 0 else y


def condition(x: np.ndarray, fs: float, order: int = 4, clip: float = 8.0, low: float = 3.0, high: float = 25.0) -> np.ndarray:
    """Centred at the median, clipped at `clip` MAD, band-passed where the sampling rate allows it."""
    c = x - np.median(x)
    mad = np.median(np.abs(c))
    if mad > 0:
        c = np.clip(c, -clip * mad, clip * mad)
    high = min(high, 0.45 * fs)
    return zero_phase(butter_sos(order, low, high, fs), c) if low < high and len(x) > 3 else c


def peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Positions of local maxima (the middle of flat ones) of at least the prominence, the highest first within the
    distance."""
    n = len(x)
    if n < 3:
        return np.empty(0, np.int64)
    found, i = [], 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    p = np.array(found, np.int64)
    kept = np.ones(len(p), bool)
    for k in np.argsort(-x[p], kind="stable"):
        if kept[k]:
            near = np.abs(p - p[k]) < distance
            near[k] = False
            kept &= ~near
    p = p[kept]
    out = []
    for q in p:
        a = b = x[q]
        i = q
        while i >= 0 and x[i] <= x[q]:
            a = min(a, x[i])
            i -= 1
        i = q
        while i < n and x[i] <= x[q]:
            b = min(b, x[i])
            i += 1
        if x[q] - max(a, b) >= prominence:
            out.append(q)
    return np.array(out, np.int64)


def detect_events(x: np.ndarray, fs: float, scale: float = 1.5, refractory: float = 0.45) -> np.ndarray:
    """Peaks of the signal or of its mirror image, whichever stands out more."""
    s = 1.4826 * np.median(np.abs(x - np.median(x)))
    d = max(1, int(refractory * fs))
    up, down = peaks(x, d, scale * s), peaks(-x, d, scale * s)
    strength = lambda p, y: np.median(y[p]) if len(p) else -np.inf
    return up if strength(up, x) >= strength(down, -x) else down


def ricker(x: np.ndarray, width: float) -> np.ndarray:
    n = min(int(10 * width), len(x))
    t = np.arange(n) - (n - 1) / 2
    w = 2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - (t / width) ** 2) * np.exp(-(t**2) / (2 * width**2))
    return np.convolve(x, w, "same")


def _per_series(df: DataFrame, key: str, order: str, f, schema: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(order))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def event_rate_from_signal(df: DataFrame, key: str, pos: str, value: str, fs: float) -> DataFrame:
    """Each series' detected events with the rate per minute since the one before: key, pos, rate."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        p = detect_events(condition(pdf[value].to_numpy(float), fs), fs)
        rate = 60 * fs / np.diff(p) if len(p) > 1 else np.empty(0)
        return pd.DataFrame({"pos": pdf[pos].to_numpy()[p[1:]] if len(p) > 1 else np.empty(0, np.int64), "rate": rate})

    return _per_series(df, key, pos, f, "pos bigint, rate double")


def wavelet_scale(df: DataFrame, key: str, pos: str, value: str, widths: tuple[float, ...] = (2, 4, 8)) -> DataFrame:
    """log(1 + the strongest positive wavelet response) over the widths: key, pos, strength."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        top = np.max([np.maximum(ricker(x, w), 0) for w in widths], axis=0)
        return pd.DataFrame({"pos": pdf[pos].to_numpy(), "strength": np.log1p(top)})

    return _per_series(df, key, pos, f, "pos bigint, strength double")


def combine_convolve(df: DataFrame, key: str, pos: str, parts: list[str]) -> DataFrame:
    """Columns convolved one after another ('same' length), scaled to a maximum of 1 after each: key, pos, combined."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[parts[0]].to_numpy(float)
        for c in parts[1:]:
            y = np.convolve(y, pdf[c].to_numpy(float), "same")[: len(y)]
            top = np.max(np.abs(y)) if len(y) else 0.0
            y = y / top if top > 0 else y
        return pd.DataFrame({"pos": pdf[pos].to_numpy(), "combined": y})

    return _per_series(df, key, pos, f, "pos bigint, combined double")


def dual_averaging(accept: np.ndarray, target: float = 0.65, eps: float = 1.0, gamma: float = 0.05, t0: float = 10.0, kappa: float = 0.75) -> float:
    """The step size that a run of acceptance rates settles on; the start where there are none."""
    if not len(accept):
        return eps
    mu, err, bar = np.log(10 * eps), 0.0, 0.0
    for m, a in enumerate(accept, 1):
        err += (target - a - err) / (m + t0)
        log_eps = mu - np.sqrt(m) / gamma * err
        weight = m**-kappa
        bar = weight * log_eps + (1 - weight) * bar
    return float(np.exp(bar))


def step_sizes(df: DataFrame, key: str, pos: str, accept: str) -> DataFrame:
    return _per_series(df, key, pos, lambda p: pd.DataFrame({"step": [dual_averaging(p[accept].to_numpy(float))]}), "step double")


def matrix_checks(df: DataFrame, key: str, row: str, col: str, value: str) -> DataFrame:
    """Condition number, least eigenvalue of the symmetric part, rank and asymmetry of each key's matrix, given as
    (row, col, value) with 0 for what is missing."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf[row].max(), pdf[col].max())) + 1
        a = np.zeros((n, n))
        a[pdf[row].astype(int), pdf[col].astype(int)] = pdf[value]
        s = np.linalg.svd(a, compute_uv=False)
        return pd.DataFrame({
            "condition": [s[0] / s[-1] if s[-1] > 0 else np.inf], "least_eigenvalue": [np.linalg.eigvalsh((a + a.T) / 2)[0]],
            "rank": [int(np.sum(s > 1e-10 * s[0]))], "asymmetry": [float(np.max(np.abs(a - a.T)))],
        })

    return _per_series(df, key, row, f, "condition double, least_eigenvalue double, rank int, asymmetry double")


def chain_diagnostics(df: DataFrame, key: str, chain: str, pos: str, value: str) -> DataFrame:
    """Split R-hat on rank-normalised values and bulk effective sample size of each key's chains (cut to the
    shortest): key, rhat, ess."""

    def normal(p: np.ndarray) -> np.ndarray:
        """Quantiles of the normal distribution, by Newton steps on its distribution function."""
        from math import erf, sqrt

        z = np.sign(p - 0.5) * np.sqrt(np.maximum(-2 * np.log(np.minimum(p, 1 - p)), 0))
        z *= 0.8
        cdf = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))
        for _ in range(30):
            z = z - np.clip((cdf(z) - p) / np.maximum(np.exp(-z * z / 2) / np.sqrt(2 * np.pi), 1e-12), -1, 1)
        return z

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values(pos)[value].to_numpy(float) for _, g in pdf.groupby(chain)]
        half = min(map(len, groups)) // 2
        if half < 2:
            return pd.DataFrame({"rhat": [1.0], "ess": [float(len(pdf))]})
        x = np.array([part for g in groups for part in (g[:half], g[half : 2 * half])])
        rank = pd.Series(x.ravel()).rank().to_numpy().reshape(x.shape)
        z = normal((rank - 0.375) / (x.size + 0.25))
        m, n = z.shape
        within, between = z.var(axis=1, ddof=1).mean(), n * z.mean(axis=1).var(ddof=1)
        total = (n - 1) / n * within + between / n
        rhat = np.sqrt(total / within) if within > 0 else 1.0
        c = z - z.mean(axis=1, keepdims=True)
        acov = np.array([(c[:, : n - t] * c[:, t:]).sum(axis=1).mean() / n for t in range(n)])
        rho = 1 - (within - acov * n / max(n - 1, 1)) / total if total > 0 else np.zeros(n)
        tau, last = -1.0, np.inf
        for t in range(0, n - 1, 2):
            pair = rho[t] + rho[t + 1]
            if pair < 0:
                break
            last = min(last, pair)
            tau += 2 * last
        return pd.DataFrame({"rhat": [float(rhat)], "ess": [float(m * n / max(tau, 1 / np.log10(max(m * n, 10))))]})

    return _per_series(df, key, pos, f, "rhat double, ess double")


def fit_segments(df: DataFrame, key: str, pos: str, value: str, rising: bool = True, floor: float = 0.0, min_width: int = 3, model: str = "exp") -> DataFrame:
    """Rising (or falling) runs of at least `min_width` samples with the rate of the curve that fits them best,
    v = A (exp(a i) - 1) + v0, or A sinh(a i) + v0 for the model 'sinh', by a search over a: key, first, last, rate,
    strength = log(1 + |A a|)."""
    rates = np.geomspace(1e-3, 2, 60)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x, at = pdf[value].to_numpy(float), pdf[pos].to_numpy()
        d = np.diff(x)
        on = np.concatenate(([False], d > floor if rising else d < -floor, [False]))
        edges = np.flatnonzero(np.diff(on.astype(int)))
        out = []
        for a, b in edges.reshape(-1, 2):
            seg = x[a : b + 1]
            if len(seg) < min_width:
                continue
            i = np.arange(len(seg))
            best = (np.inf, 0.0, 0.0)
            for r in rates:
                e = np.sinh(np.minimum(r * i, 50.0)) if model == "sinh" else np.expm1(r * i) if rising else -np.expm1(-r * i)
                amp = (e @ (seg - seg[0])) / (e @ e)
                best = min(best, (float(((seg - seg[0] - amp * e) ** 2).sum()), r, amp))
            out.append((at[a], at[b], best[1], float(np.log1p(abs(best[1] * best[2])))))
        return pd.DataFrame(out, columns=["first", "last", "rate", "strength"])

    return _per_series(df, key, pos, f, "first bigint, last bigint, rate double, strength double")


def combine_coherence(df: DataFrame, key: str, pos: str, parts: list[str], window: int = 16) -> DataFrame:
    """The mean of columns, each weighted by how it runs with the others in a moving window: key, pos, combined."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[parts].to_numpy(float)
        w = np.ones(window) / window
        low = lambda v: np.convolve(v, w, "same")[: len(v)] if len(v) >= window else np.full(len(v), v.mean())
        weight = np.zeros_like(m)
        for i in range(m.shape[1]):
            for j in range(i):
                num = low(m[:, i] * m[:, j]) ** 2
                coh = num / np.maximum(low(m[:, i] ** 2) * low(m[:, j] ** 2), 1e-30)
                weight[:, i] += coh
                weight[:, j] += coh
        total = np.maximum(weight.sum(axis=1), 1e-30)
        return pd.DataFrame({"pos": pdf[pos].to_numpy(), "combined": (m * weight).sum(axis=1) / total})

    return _per_series(df, key, pos, f, "pos bigint, combined double")


def observability(df: DataFrame, key: str, f: str, h: str, n: int, m: int = 1) -> DataFrame:
    """(key, rank, observable): the rank of [H; HF; ...; HF^(n-1)] of each row's system.

    f holds the n x n transition and h the m x n measurement matrix row by row; rows with other sizes or nulls have
    rank 0. Rows are taken in batches, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ranks = []
            for a, c in zip(b["f"], b["h"]):
                if a is None or c is None or len(a) != n * n or len(c) != m * n:
                    ranks.append(0)
                    continue
                step, part = np.asarray(a, float).reshape(n, n), [np.asarray(c, float).reshape(m, n)]
                for _ in range(n - 1):
                    part.append(part[-1] @ step)
                ranks.append(int(np.linalg.matrix_rank(np.vstack(part))))
            yield pd.DataFrame({"key": b["key"], "rank": np.array(ranks, np.int64)})

    out = df.select(F.col(key).alias("key"), F.col(f).alias("f"), F.col(h).alias("h")).mapInPandas(run, f"key {kind}, rank bigint")
    return out.select(F.col("key").alias(key), "rank", (F.col("rank") == n).alias("observable"))
