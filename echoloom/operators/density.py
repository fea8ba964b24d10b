"""Density, peaks and one-dimensional Gaussian mixtures of one passage's counts by value, inside the task that follows it.

Models of whole recordings are fitted by Spark (operators.mixtures); tests hold the two against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MixtureConfig

ROOT_2PI = float(np.sqrt(2 * np.pi))


@dataclass
class Mixture:
    """A fitted model: components by ascending mean, and the density and peaks that it began from."""

    means: np.ndarray
    sigmas: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    density: np.ndarray
    peaks: np.ndarray

    @property
    def k(self) -> int:
        return len(self.means)

    def density_at(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[:, None] - self.means) / self.sigmas
        return (self.weights * np.exp(-0.5 * z * z) / (self.sigmas * ROOT_2PI)).sum(1)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[:, None] - self.means) / self.sigmas
        logs = np.log(self.weights) - np.log(self.sigmas) - 0.5 * z * z
        shares = np.exp(logs - logs.max(1, keepdims=True))
        return shares / shares.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.posteriors(x).argmax(1)

    def thresholds(self, flavor: str = "canonical") -> np.ndarray:
        """Places of least density between neighbouring means; web looks at 160 points, canonical narrows the interval."""
        found = []
        for a, b in zip(self.means[:-1], self.means[1:]):
            points = np.linspace(a, b, 160)
            at = int(self.density_at(points).argmin())
            if flavor == "web":
                found.append(points[at])
                continue
            low, high = points[max(0, at - 1)], points[min(159, at + 1)]
            ratio = (np.sqrt(5) - 1) / 2
            while high - low > 1e-7 * max(1.0, abs(high)):
                left, right = high - ratio * (high - low), low + ratio * (high - low)
                if self.density_at([left])[0] <= self.density_at([right])[0]:
                    high = right
                else:
                    low = left
            found.append((low + high) / 2)
        return np.array(found)


def spread(x: np.ndarray, n: np.ndarray) -> float:
    """Sample standard deviation of weighted values."""
    total = n.sum()
    mean = (n * x).sum() / total
    return float(np.sqrt((n * (x - mean) ** 2).sum() / (total - 1)))


def quantile(x: np.ndarray, n: np.ndarray, q: float) -> float:
    """Linear quantile of ascending weighted values."""
    place = q * (n.sum() - 1)
    ends = np.cumsum(n)
    low, high = (x[np.searchsorted(ends, k, side="right")] for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def bandwidth(x: np.ndarray, n: np.ndarray, config: MixtureConfig) -> float:
    total, sd = n.sum(), spread(x, n)
    if config.flavor == "web":
        sd = max(sd, 1e-9**0.5)
        if config.bandwidth == "silverman":
            between = quantile(x, n, 0.75) - quantile(x, n, 0.25)
            return max(0.05, 0.9 * min(sd, between / 1.34 if between > 0 else sd) * total**-0.2 * config.scale)
        return max(0.05, sd * total**-0.2 * config.scale)
    if config.bandwidth == "scott":
        factor = total**-0.2
    elif config.bandwidth == "silverman":
        factor = (total * 0.75) ** -0.2
    else:
        factor = float(config.bandwidth)
    return factor * config.scale * sd


def kernel_density(x: np.ndarray, n: np.ndarray, grid: np.ndarray, width: float) -> np.ndarray:
    z = (grid[:, None] - x) / width
    return np.exp(-0.5 * z * z) @ n / (n.sum() * width * ROOT_2PI)


def prominences(y: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points between it and higher ground on either side."""
    out = []
    for p in peaks:
        left = np.flatnonzero(y[:p] > y[p])
        right = np.flatnonzero(y[p + 1 :] > y[p])
        a = y[(left[-1] if len(left) else 0) : p + 1].min()
        b = y[p : (p + 1 + right[0] if len(right) else len(y)) + (1 if len(right) else 0)].min()
        out.append(y[p] - max(a, b))
    return np.array(out)


def _maxima(y: np.ndarray) -> np.ndarray:
    """Middles of strict local maxima, level tops included."""
    change = np.flatnonzero(np.diff(y)) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(y)]])
    level = y[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (starts[top] + ends[top] - 1) // 2


def _thin(y: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Of peaks closer than distance the higher stays, highest first."""
    left = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if left[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            left &= ~near
    return peaks[left]


def find_peaks(grid: np.ndarray, y: np.ndarray, config: MixtureConfig, min_distance: float) -> np.ndarray:
    """Indices of peaks. canonical: distance, then prominence, then the highest few; web: prominence between neighbours,
    then distance, then the leftmost few. With none canonical takes the highest point."""
    distance = max(1, int(round(min_distance / (grid[1] - grid[0]))))
    least = y.max() * config.prominence
    if config.flavor == "web":
        inner = np.arange(1, len(y) - 1)
        found = inner[(y[inner] > y[inner - 1]) & (y[inner] >= y[inner + 1])]
        bounds = np.concatenate([[0], found, [len(y) - 1]])
        rise = [y[p] - max(y[a : p + 1].min(), y[p : b + 1].min()) for a, p, b in zip(bounds[:-2], found, bounds[2:])]
        return np.sort(_thin(y, found[np.array(rise) >= least] if len(found) else found, distance))[: config.max_components]
    found = _thin(y, _maxima(y), distance)
    found = found[prominences(y, found) >= least] if len(found) else found
    if not len(found):
        return np.array([int(y.argmax())])
    return np.sort(found[np.argsort(y[found], kind="stable")[-config.max_components :]])


def _start(x: np.ndarray, n: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Hard shares of a one-dimensional k-means that begins at the centres."""
    for _ in range(100):
        own = np.abs(x[:, None] - centres).argmin(1)
        mass = np.bincount(own, n, len(centres))
        moved = np.where(mass > 0, np.bincount(own, n * x, len(centres)) / np.maximum(mass, 1e-300), centres)
        if np.allclose(moved, centres, atol=1e-10):
            break
        centres = moved
    return (own[:, None] == np.arange(len(centres))).astype(float)


def fit_mixture(x: np.ndarray, n: np.ndarray, peaks: np.ndarray, flavor: str = "canonical") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, sigmas, weights) by expectation-maximisation from the peaks.

    canonical: weights and variances of a k-means begin; 1e-6 is added to variances; ends when the mean log-likelihood
    moves by less than 1e-3, after 100 rounds at most. web: equal weights; sigma of 0.05 at least; relative change of
    1e-5, 120 rounds.
    """
    total, k, web = n.sum(), len(peaks), flavor == "web"
    means = np.array(peaks, float)
    if web:
        sigma = np.sqrt(max(spread(x, n) ** 2 if total > 1 else 0.0, 0.05))
        variances, weights = np.full(k, max(sigma / np.sqrt(k), 0.15) ** 2), np.full(k, 1 / k)
    else:
        shares = _start(x, n, means) * n[:, None]
        mass = shares.sum(0) + 10 * np.finfo(float).eps
        centres = (shares * x[:, None]).sum(0) / mass
        variances = (shares * (x[:, None] - centres) ** 2).sum(0) / mass + 1e-6
        weights = mass / total
    before = -np.inf
    for _ in range(120 if web else 100):
        logs = np.log(weights) - 0.5 * np.log(2 * np.pi * variances) - 0.5 * (x[:, None] - means) ** 2 / variances
        top = logs.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        shares = np.exp(logs - each[:, None]) * n[:, None]
        mass = np.maximum(shares.sum(0), 1e-6) if web else shares.sum(0) + 10 * np.finfo(float).eps
        means = np.where(shares.sum(0) < 1e-6, means, (shares * x[:, None]).sum(0) / mass) if web else (shares * x[:, None]).sum(0) / mass
        variances = (shares * (x[:, None] - means) ** 2).sum(0) / mass
        variances = np.maximum(variances, 0.05**2) if web else variances + 1e-6
        weights = mass / total
        now = float((n * each).sum())
        if abs(now - before) < (1e-5 * max(1.0, abs(now)) if web else 1e-3 * total):
            break
        before = now
    order = np.argsort(means, kind="stable")
    return means[order], np.sqrt(variances[order]), weights[order]


def fit(values: np.ndarray, counts: np.ndarray, config: MixtureConfig = MixtureConfig()) -> Mixture:
    """Density, peaks and a mixture with one component a peak, from finite values and their counts."""
    values, counts = np.asarray(values, float), np.asarray(counts, float)
    good = np.isfinite(values) & (counts > 0)
    order = np.argsort(values[good], kind="stable")
    x, n = values[good][order], counts[good][order]
    if n.sum() < 2:
        raise ValueError("at least two finite values are needed")
    if abs(x[0] - x[-1]) <= 1e-8 + 1e-5 * abs(x[-1]):
        one = np.array([x[0]])
        means, sigmas, weights = fit_mixture(x, n, one)
        return Mixture(means, sigmas, weights, one, np.ones(1), one)
    width = bandwidth(x, n, config)
    pad = max(0.5, (x[-1] - x[0]) * 0.02)
    grid = np.linspace(x[0] - pad, x[-1] + pad, config.grid)
    density = kernel_density(x, n, grid, width)
    peaks = grid[find_peaks(grid, density, config, width if config.min_distance_khz is None else config.min_distance_khz)]
    means, sigmas, weights = fit_mixture(x, n, peaks if len(peaks) else np.array([grid[density.argmax()]]), config.flavor)
    return Mixture(means, sigmas, weights, grid, density, peaks)


def kde_table(rows: DataFrame, grid: DataFrame, width: float, value: str = "fme_khz") -> DataFrame:
    """Density at grid points (x) as an expression over the histogram; the histogram is the small side of the join."""
    hist = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").cast("double").alias("n"))
    packed = hist.agg(F.collect_list(F.struct("value", "n")).alias("h"), F.sum("n").alias("total"))
    model = grid.withColumn("_m", packed.select(F.struct("h", "total")).scalar())
    z = lambda p: (F.col("x") - p["value"]) / width
    total = F.aggregate(F.col("_m.h"), F.lit(0.0), lambda s, p: s + p["n"] * F.exp(-0.5 * z(p) * z(p)))
    return model.select("x", (total / (F.col("_m.total") * width * ROOT_2PI)).alias("density"))
