"""Signal operators on long series (series_id, idx, x): windows in SQL where frames suffice, numpy kernels per series else."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.stats import chi2_quantile, entropy_of_counts, herfindahl_of_counts


def _order() -> Window:
    return Window.partitionBy("series_id").orderBy("idx")


# ---------------------------------------------------------------- constant false alarm rate


def ca_alpha(cells: int, pfa: float) -> float:
    return cells * (pfa ** (-1.0 / cells) - 1.0)


def os_alpha(cells: int, rank: int, pfa: float) -> float:
    """Threshold factor of the rank-th order statistic, by bisection on its false-alarm rate."""

    def rate(a: float) -> float:
        return math.exp(sum(math.log((cells - i) / (a + cells - i)) for i in range(rank)))

    lo, hi = 0.0, 1.0
    while rate(hi) > pfa:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rate(mid) > pfa else (lo, mid)
    return (lo + hi) / 2


def ca_cfar(series: DataFrame, guard: int = 2, train: int = 8, pfa: float = 1e-3) -> DataFrame:
    """threshold from the mean of the training cells on both sides; null at the edges, where nothing is decided."""
    lead = _order().rowsBetween(-guard - train, -guard - 1)
    lag = _order().rowsBetween(guard + 1, guard + train)
    n = F.count("x").over(lead) + F.count("x").over(lag)
    mean = (F.sum("x").over(lead) + F.sum("x").over(lag)) / (2 * train)
    d = series.withColumn("threshold", F.when(n == 2 * train, mean * ca_alpha(2 * train, pfa)))
    return d.withColumn("detected", F.coalesce(F.col("x") > F.col("threshold"), F.lit(False)))


def os_cfar(series: DataFrame, guard: int = 2, train: int = 8, rank: int | None = None, pfa: float = 1e-3) -> DataFrame:
    """threshold from the rank-th smallest training cell (default: three quarters up)."""
    cells = 2 * train
    rank = rank or max(1, round(0.75 * cells))
    near = F.concat(F.collect_list("x").over(_order().rowsBetween(-guard - train, -guard - 1)), F.collect_list("x").over(_order().rowsBetween(guard + 1, guard + train)))
    d = series.withColumn("_c", F.sort_array(near))
    d = d.withColumn("threshold", F.when(F.size("_c") == cells, F.try_element_at("_c", F.lit(rank)) * os_alpha(cells, rank, pfa))).drop("_c")
    return d.withColumn("detected", F.coalesce(F.col("x") > F.col("threshold"), F.lit(False)))


# ---------------------------------------------------------------- sliding windows


def _sliding(series: DataFrame, value: Column, window: int, step: int, make: Callable[[Column], Column], name: str) -> DataFrame:
    """A statistic of the last `window` samples, every `step` samples from the first full window on."""
    w = _order().rowsBetween(-(window - 1), 0)
    d = series.withColumns({"_v": value, "_k": F.row_number().over(_order()) - window}).withColumn("_l", F.collect_list("_v").over(w))
    d = d.where((F.col("_k") >= 0) & (F.col("_k") % step == 0))
    return d.select("series_id", (F.col("_k") / step).cast("int").alias("window"), make(F.col("_l")).alias(name))


def _tally(values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda y: y == v)))


def sliding_entropy(series: DataFrame, window: int, step: int = 1) -> DataFrame:
    return _sliding(series, F.rint("x").cast("long"), window, step, lambda v: entropy_of_counts(_tally(v)), "entropy")


def sliding_distinct(series: DataFrame, window: int, step: int = 1) -> DataFrame:
    return _sliding(series, F.rint("x").cast("long"), window, step, lambda v: F.size(F.array_distinct(v)), "distinct_codes")


def sliding_herfindahl(series: DataFrame, window: int, step: int = 1) -> DataFrame:
    return _sliding(series, F.rint("x").cast("long"), window, step, lambda v: herfindahl_of_counts(_tally(v)), "hhi")


def sliding_kl(series: DataFrame, baseline: list[float], window: int, step: int = 1, smoothing: float = 0.5) -> DataFrame:
    """KL of each window's codes against baseline counts over 0..K-1, both smoothed by adding `smoothing`."""
    k = len(baseline)
    q = [(c + smoothing) / (sum(baseline) + smoothing * k) for c in baseline]

    def equals(code: int) -> Callable[[Column], Column]:
        return lambda y: y == code

    def kl(v: Column) -> Column:
        total = F.lit(0.0)
        for code, qc in enumerate(q):
            p = (F.size(F.filter(v, equals(code))) + smoothing) / (window + smoothing * k)
            total = total + p * F.log(p / qc) / math.log(2.0)
        return total

    return _sliding(series, F.rint("x").cast("long"), window, step, kl, "kl")


def sliding_mi(pairs: DataFrame, window: int, step: int = 1) -> DataFrame:
    """Mutual information in bits of the codes x and y of each window, from pairs(series_id, idx, x, y); never negative."""

    def mi(v: Column) -> Column:
        x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
        h = entropy_of_counts(_tally(x)) + entropy_of_counts(_tally(y)) - entropy_of_counts(_tally(v))
        return F.greatest(F.lit(0.0), h)

    code = F.struct(F.rint("x").cast("long").alias("x"), F.rint("y").cast("long").alias("y"))
    return _sliding(pairs, code, window, step, mi, "mi")


def mi_null(pairs: DataFrame, window: int, step: int = 1, permutations: int = 200, seed: int = 7) -> DataFrame:
    """sliding_mi() of each series with its y shuffled as a whole, `permutations` times: series_id, permutation, window, mi.

    Every shuffle keeps both marginals and the window, so these values carry the same bias as the observed ones and can
    calibrate them. Each series is read once, by one task, and each shuffle's rows are written as they come.
    """
    name = pairs.schema["series_id"].dataType.simpleString()

    def entropies(codes: np.ndarray) -> np.ndarray:
        """Per row of codes the entropy of its values, by runs of the sorted row."""
        s = np.sort(codes, axis=1)
        n, w = s.shape
        starts = np.ones((n, w), bool)
        starts[:, 1:] = s[:, 1:] != s[:, :-1]
        at = np.flatnonzero(starts.ravel())
        runs = np.diff(np.append(at, n * w))
        return math.log2(w) - np.bincount(at // w, runs * np.log2(runs), minlength=n) / w

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(parts)).sort_values("idx")
        x, y = (np.unique(np.rint(d[c].to_numpy(float)), return_inverse=True)[1].ravel() for c in ("x", "y"))
        if len(x) < window:
            return
        view = lambda c: np.lib.stride_tricks.sliding_window_view(c, window)[::step]
        hx, rng = entropies(view(x)), np.random.default_rng(seed)
        for k in range(permutations):
            z = rng.permutation(y)
            mi = np.maximum(0.0, hx + entropies(view(z)) - entropies(view(x * (y.max() + 1) + z)))
            yield pd.DataFrame({"series_id": key[0], "permutation": k, "window": np.arange(len(mi)), "mi": mi})

    return pairs.select("series_id", "idx", "x", "y").groupBy("series_id").applyInPandas(run, f"series_id {name}, permutation int, window int, mi double")


def dominant(spectra: DataFrame, top: int = 5) -> DataFrame:
    """Per series the `top` frequencies of most power, the constant part aside: spectra(series_id, freq, power) with rank."""
    w = Window.partitionBy("series_id").orderBy(F.desc("power"), "freq")
    return spectra.where("freq > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# ---------------------------------------------------------------- window sizes that divide a length


def divisors(n: int) -> list[int]:
    if n < 1:
        raise ValueError("only positive numbers have divisors here")
    low = [d for d in range(1, math.isqrt(n) + 1) if n % d == 0]
    return sorted({*low, *(n // d for d in low)})


def prime_factors(n: int) -> set[int]:
    return {d for d in divisors(n) if len(divisors(d)) == 2}


def neighbours(d: int, n: int) -> list[int]:
    """Divisors of n that are one prime factor away from its divisor d."""
    if n % d:
        raise ValueError(f"{d} does not divide {n}")
    return [e for e in divisors(n) if len(divisors(max(d, e) // min(d, e))) == 2 and max(d, e) % min(d, e) == 0]


def scales(n: int, start: int, hops: int) -> dict[int, int]:
    """Window sizes within `hops` prime steps of `start` among the divisors of n, with their distance."""
    near, front = {start: 0}, [start]
    for hop in range(1, hops + 1):
        front = sorted({e for d in front for e in neighbours(d, n)} - set(near))
        near |= dict.fromkeys(front, hop)
    return near


def blocks(series: DataFrame, nperseg: int, noverlap: int | None = None) -> DataFrame:
    """Samples with the blocks they belong to: series_id, block, j (place in the block), x. Only full blocks."""
    step = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    n = F.count("*").over(Window.partitionBy("series_id"))
    d = series.withColumns({"_i": F.row_number().over(_order()) - 1, "_n": n})
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - nperseg) / step)).cast("int")
    first = F.greatest(F.ceil((F.col("_i") - nperseg + 1) / F.lit(float(step))), F.lit(0)).cast("int")
    d = d.where(F.col("_n") >= nperseg).withColumns({"_a": first, "_b": last}).where("_a <= _b")
    d = d.select("series_id", "x", "_i", F.explode(F.sequence("_a", "_b")).alias("block"))
    return d.select("series_id", "block", (F.col("_i") - F.col("block") * step).alias("j"), "x")


def energy(series: DataFrame, nperseg: int = 256, noverlap: int | None = None, noise_var: float | None = None, pfa: float = 1e-3) -> DataFrame:
    """Block energy over noise variance against a chi-square threshold; unknown noise comes from the median energy."""
    e = blocks(series, nperseg, noverlap).groupBy("series_id", "block").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    median = chi2_quantile(0.5, nperseg)
    noise = F.lit(float(noise_var)) if noise_var is not None else F.median("energy").over(Window.partitionBy("series_id")) / median
    d = e.withColumn("statistic", F.col("energy") / noise)
    return d.withColumn("detected", F.col("statistic") > chi2_quantile(pfa, nperseg))


def goertzel(series: DataFrame, freq: float, fs: float, nperseg: int, noverlap: int | None = None) -> DataFrame:
    """Power of one frequency per block: the squared modulus of the block's sum against a complex tone."""
    if abs(freq) > fs / 2:
        raise ValueError("frequency beyond half the sampling rate")
    w = 2 * math.pi * freq / fs
    b = blocks(series, nperseg, noverlap).groupBy("series_id", "block").agg(F.sum(F.col("x") * F.cos(F.col("j") * w)).alias("re"), F.sum(F.col("x") * F.sin(F.col("j") * w)).alias("im"))
    return b.select("series_id", "block", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


# ---------------------------------------------------------------- kernels


def cusum_arl(k: float, h: float, delta: float = 0.0) -> float:
    b, drift = h + 1.166, delta - k
    return b * b if abs(drift) < 1e-9 else float((math.exp(-2 * drift * b) + 2 * drift * b - 1) / (2 * drift * drift))


def cusum_kernel(x: np.ndarray, target: float | None = None, sigma: float | None = None, k: float = 0.5, h: float = 5.0, reset: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low sums and alarms (+1, -1, 0)."""
    mu = float(np.median(x)) if target is None else target
    if sigma is None:
        sigma = 1.4826 * float(np.median(np.abs(x - np.median(x)))) or float(np.std(x)) or 1.0
    hi, lo, alarm = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), int)
    a = c = 0.0
    for i, z in enumerate((x - mu) / sigma):
        a, c = max(0.0, a + z - k), max(0.0, c - z - k)
        hi[i], lo[i] = a, c
        if a > h or c > h:
            alarm[i] = 1 if a > h else -1
            if reset:
                a = c = 0.0
    return hi, lo, alarm


def welch_kernel(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density by averaged, Hann-windowed, mean-free half-overlapping segments."""
    n = min(nperseg, len(x))
    step = max(1, n - n // 2)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segs = np.stack([x[i : i + n] for i in range(0, len(x) - n + 1, step)])
    f = np.fft.rfft((segs - segs.mean(axis=1, keepdims=True)) * w, axis=1)
    p = (np.abs(f) ** 2).mean(axis=0) / (fs * (w**2).sum())
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def butter_sections(order: int, cutoff, fs: float, kind: str = "lowpass") -> list[tuple[np.ndarray, np.ndarray]]:
    """Digital Butterworth filter as second-order sections (b, a), by the bilinear transform."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = 2 * fs * np.tan(np.pi * np.atleast_1d(cutoff) / fs)
    if kind == "lowpass":
        p, z, g = poles * warp[0], np.empty(0), warp[0] ** order
    elif kind == "highpass":
        p, z, g = warp[0] / poles, np.zeros(order), 1.0
    else:
        bw, w0 = warp[1] - warp[0], math.sqrt(warp[0] * warp[1])
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p, z, g = np.concatenate((half + root, half - root)), np.zeros(order), bw**order
    dz = (2 * fs + z) / (2 * fs - z)
    dp = (2 * fs + p) / (2 * fs - p)
    gain = np.real(g * np.prod(2 * fs - z) / np.prod(2 * fs - p))
    dz = np.concatenate((dz, -np.ones(len(p) - len(dz))))
    pairs = _conjugates(dp)
    zeros = sorted(np.real(dz), key=lambda v: -v)
    out = []
    for i, pair in enumerate(pairs):
        # one zero from each end, so that band-pass sections have one at each
        take = [zeros.pop(0) if i % 2 == 0 or len(zeros) == 1 else zeros.pop()]
        if len(pair) == 2 and zeros:
            take.append(zeros.pop())
        out.append((np.real(np.poly(take)), np.real(np.poly(pair))))
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def _conjugates(p: np.ndarray) -> list[np.ndarray]:
    upper = [x for x in p if x.imag > 1e-12]
    real = sorted((x.real for x in p if abs(x.imag) <= 1e-12), reverse=True)
    out = [np.array([x, np.conj(x)]) for x in upper]
    while real:
        out.append(np.array(real[:2]))
        real = real[2:]
    return out


def _section(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One section with the state of a constant input at x[0]."""
    b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
    level = x[0] * b.sum() / a.sum() if abs(a.sum()) > 1e-14 else 0.0
    s1 = level - b[0] * x[0]
    s2 = b[2] * x[0] - a[2] * level
    out = np.empty_like(x)
    for i, v in enumerate(x):
        y = b[0] * v + s1
        s1 = b[1] * v - a[1] * y + s2
        s2 = b[2] * v - a[2] * y
        out[i] = y
    return out


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forwards and backwards over the signal, extended at both ends by its point reflection."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad else x.astype(float)
    for _ in range(2):
        for b, a in sections:
            y = _section(y, b, a)
        y = y[::-1]
    return y[pad : len(y) - pad] if pad else y


def notch_section(freq: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * np.pi * freq / fs
    g = 1 / (1 + np.tan(w / q / 2))
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


def lock_in_kernel(x: np.ndarray, freq: float, bandwidth: float, fs: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude and phase of a tone: mixed to zero, low-passed without delay."""
    z = x * np.exp(-2j * np.pi * freq * np.arange(len(x)) / fs)
    s = butter_sections(order, bandwidth, fs)
    y = zero_phase(z.real.copy(), s) + 1j * zero_phase(z.imag.copy(), s)
    return 2 * np.abs(y), np.angle(y)


def matched_kernel(x: np.ndarray, template: np.ndarray, noise_var: float = 1.0, noise_cov: np.ndarray | None = None) -> np.ndarray:
    """Normalised correlation with a template, whitened by the noise covariance if given."""
    h = template if noise_cov is None else np.linalg.solve(noise_cov, template)
    norm = math.sqrt(noise_var) * np.linalg.norm(template) if noise_cov is None else math.sqrt(template @ h)
    return np.correlate(x, h, mode="valid") / norm


def per_series(series: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Apply a numpy kernel to each whole series in index order: schema names its outputs, `idx` counts them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = kernel(rows.sort_values("idx")["x"].to_numpy(float))
        n = len(next(iter(out.values())))
        return pd.DataFrame({"series_id": [key[0]] * n, "idx": np.arange(n)} | out)

    return series.groupBy("series_id").applyInPandas(run, f"series_id string, idx long, {schema}")


def viterbi(observations: list[str], transitions: dict, emissions: dict, starts: dict, eps: float = 1e-9) -> list[str]:
    """Most likely hidden states: transitions[a][b], emissions[state][symbol], starts[state]; missing entries count eps."""
    states = sorted(set(starts) | set(transitions) | {b for row in transitions.values() for b in row} | set(emissions))
    if not observations or not states:
        return []
    log = lambda p: math.log(p if p and p > 0 else eps)
    score = {s: log(starts.get(s)) + log(emissions.get(s, {}).get(observations[0])) for s in states}
    back = []
    for o in observations[1:]:
        new, ptr = {}, {}
        for s in states:
            best = max(states, key=lambda p: (score[p] + log(transitions.get(p, {}).get(s)), -states.index(p)))
            new[s] = score[best] + log(transitions.get(best, {}).get(s)) + log(emissions.get(s, {}).get(o))
            ptr[s] = best
        score = new
        back.append(ptr)
    last = max(states, key=lambda s: (score[s], -states.index(s)))
    path = [last]
    for ptr in reversed(back):
        path.append(ptr[path[-1]])
    return path[::-1]
