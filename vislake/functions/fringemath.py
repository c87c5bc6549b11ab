"""Fringe search on one baseline's time-frequency plane (C1-C8): NumPy kernels without Spark.

The plane S holds sums of w V per lattice cell, D is the sum of w. The search zero-pads to a smooth length and transforms
the frequency axis first, so that only the delays of the window are carried through the transform of the time axis.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

TWO_PI = 2 * np.pi


@dataclass(frozen=True)
class Lattice:
    """origin + step * (0 .. n-1)."""

    origin: float
    step: float
    n: int

    def snap(self, x: np.ndarray) -> np.ndarray:
        """Nearest cell, ties away from zero, clipped to the lattice."""
        k = (np.asarray(x, float) - self.origin) / self.step
        return np.clip(np.where(k < 0, np.ceil(k - 0.5), np.floor(k + 0.5)).astype(int), 0, self.n - 1)

    def residual(self, x: np.ndarray) -> tuple[float, float]:
        """Root mean square and largest distance to the nearest point of the endless lattice."""
        d = np.asarray(x, float) - self.origin
        e = np.abs(d - np.rint(d / self.step) * self.step)
        return float(np.sqrt(np.mean(e**2))), float(e.max())

    def points(self) -> np.ndarray:
        return self.origin + self.step * np.arange(self.n)


def unit_step(x: np.ndarray) -> float:
    """Mean of the positive steps within half and one and a half times their lower quartile."""
    d = np.diff(np.unique(x))
    if not len(d):
        raise ValueError("fewer than two different samples: no step")
    base = np.quantile(d, 0.25)
    near = d[(d >= 0.5 * base) & (d <= 1.5 * base)]
    return float(near.mean() if len(near) else base)


def uniform_lattice(x: np.ndarray) -> Lattice:
    """Lattice over the samples, refined by least squares on the cell numbers; a single sample has one cell of step 1."""
    u = np.unique(np.asarray(x, float))
    if len(u) < 2:
        return Lattice(float(u[0]), 1.0, 1)
    step = unit_step(u)
    k = np.rint((u - u[0]) / step)
    origin = u[0]
    if k.max() > k.min():
        dk = k - k.mean()
        step = float((dk * (u - u.mean())).sum() / (dk**2).sum())
        origin = u.mean() - step * k.mean()
    return Lattice(float(origin), step, int(np.rint((u[-1] - origin) / step)) + 1)


def assert_uniform(lattice: Lattice, x: np.ndarray, share: float = 0.25) -> None:
    """The samples must lie on the lattice to within a share of the step (root mean square)."""
    rms, _ = lattice.residual(x)
    if rms > share * lattice.step:
        raise ValueError(f"samples are not uniform: rms distance {rms} of step {lattice.step}")


def frequency_lattice(nu: np.ndarray, width: float) -> Lattice:
    """Comb of the given channel width over the channels."""
    return Lattice(float(np.min(nu)), width, int(np.rint((np.max(nu) - np.min(nu)) / width)) + 1)


def smooth_length(n: int) -> int:
    """Smallest product of powers of 2, 3 and 5 that is at least n."""
    best, two = None, 1
    while two < 2 * n:
        three = two
        while three < 2 * n:
            m = three
            while m < n:
                m *= 5
            best = m if best is None else min(best, m)
            three *= 3
        two *= 2
    return best or 1


def _axis(s: np.ndarray, axis: int, step: float, oversample: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Padded transform along one axis, cut to the bins of [low, high] in ascending order."""
    n = s.shape[axis]
    m = smooth_length(max(int(np.rint(oversample * n)), n))
    bins = np.fft.fftshift(np.fft.fftfreq(m, step))
    keep = np.flatnonzero((bins >= low) & (bins <= high))
    if not len(keep):
        raise ValueError(f"window [{low}, {high}] keeps no bin of [{bins[0]}, {bins[-1]}]")
    full = np.fft.fft(s, n=m, axis=axis)
    return np.take(full, np.fft.fftshift(np.arange(m))[keep], axis=axis), bins[keep]


def transform(s: np.ndarray, tl: Lattice, fl: Lattice, rates: tuple[float, float], delays: tuple[float, float], oversample: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(G, rate, delay): G[r, d] = sum of S[a, b] exp(-2 pi i ((t_a - t_0) rate_r + (nu_b - nu_0) delay_d))."""
    g, delay = _axis(s, 1, fl.step, oversample[1], *delays)
    g, rate = _axis(g, 0, tl.step, oversample[0], *rates)
    return g, rate, delay


def noise_region(shape: tuple[int, int], r: int, d: int) -> np.ndarray:
    """Flat (column-major) numbers of the quarter of the plane that is farthest from the peak in both axes.

    A bin's rank is the smaller of its two separations, each as a share of its axis; at the boundary rank, bins come in
    column-major order.
    """
    n_r, n_d = shape
    k = n_r * n_d // 4
    sep = np.minimum((np.abs(np.arange(n_r) - r) / n_r)[:, None], (np.abs(np.arange(n_d) - d) / n_d)[None, :]).ravel(order="F")
    return np.argsort(-sep, kind="stable")[:k]


@dataclass(frozen=True)
class Search:
    """Windows in Hz and s, oversampling of the rate and the delay axis, refinement steps (0: none)."""

    rates: tuple[float, float]
    delays: tuple[float, float]
    oversample: tuple[float, float] = (4.0, 4.0)
    iterations: int = 2


#: Design of the quadratic through 3 x 3 bins, and its least-squares inverse.
_U, _V = (x.ravel() for x in np.meshgrid([-1.0, 0.0, 1.0], [-1.0, 0.0, 1.0], indexing="ij"))
_QUADRATIC = np.linalg.pinv(np.stack([np.ones(9), _U, _V, _U * _U, _V * _V, _U * _V], axis=1))
_regions = lru_cache(maxsize=4096)(noise_region)


def _peaks(power: np.ndarray, rate: np.ndarray, delay: np.ndarray, r: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(delay, rate, Q) per plane: peak of a quadratic through the 3 x 3 bins of |G|^2 / D, moved one bin at most; Q is the
    positive part of minus half its Hessian. A peak on the border stays, with Q = 0."""
    b = np.arange(len(r))
    inner = (r > 0) & (r < power.shape[1] - 1) & (d > 0) & (d < power.shape[2] - 1)
    q = np.zeros((len(r), 2, 2))
    tau, rho = delay[d].astype(float), rate[r].astype(float)
    k = np.flatnonzero(inner)
    if len(k):
        steps = np.array([rate[1] - rate[0], delay[1] - delay[0]])
        off = np.array([-1, 0, 1])
        near = power[b[k][:, None, None], (r[k][:, None] + off)[:, :, None], (d[k][:, None] + off)[:, None, :]].reshape(len(k), 9)
        c = near @ _QUADRATIC.T
        h = np.stack([np.stack([2 * c[:, 3], c[:, 5]], -1), np.stack([c[:, 5], 2 * c[:, 4]], -1)], -2)
        val, vec = np.linalg.eigh(-0.5 * h / np.outer(steps, steps))
        q[k] = (vec * np.maximum(val, 0)[:, None, :]) @ np.swapaxes(vec, 1, 2)
        peaked = np.all(np.linalg.eigvalsh(-h) > 0, axis=1)
        m = k[peaked]
        if len(m):
            shift = np.clip(-np.linalg.solve(h[peaked], c[peaked, 1:3][..., None])[..., 0], -1, 1) * steps
            rho[m] += shift[:, 0]
            tau[m] += shift[:, 1]
    return tau, rho, q


def _slopes(z: np.ndarray, x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Slope of the phase of z against x about the phase of the total, weighted by |z|^2, per row."""
    w = np.abs(z) ** 2
    mean = (w * x).sum(1) / np.maximum(w.sum(1), 1e-300)
    dx = x - mean[:, None]
    den = (w * dx * dx).sum(1)
    return np.where(den > 0, (w * dx * np.angle(z * np.conj(total)[:, None])).sum(1) / np.where(den > 0, den, 1), 0.0)


def measure_many(s: np.ndarray, tl: Lattice, fl: Lattice, t: np.ndarray, nu: np.ndarray, weight: np.ndarray, bandwidth: np.ndarray, search: Search) -> dict[str, np.ndarray]:
    """Peaks of planes of one shape and step (C7): delay, rate, snr, sigma_delay, coeff, q11, q12, q22, q_ab, bin widths.

    s: (plane, time, channel); t, nu: the lattices' points per plane, relative to where phases refer to; of tl and fl only
    step and length count.
    """
    g, delay = _axis(s, 2, fl.step, search.oversample[1], *search.delays)
    g, rate = _axis(g, 1, tl.step, search.oversample[0], *search.rates)
    n, n_r, _ = g.shape
    magnitude = np.abs(g)
    by_column = np.swapaxes(magnitude, 1, 2).reshape(n, -1)
    d, r = np.divmod((by_column * by_column).argmax(1), n_r)
    tau, rho, q = _peaks(magnitude**2 / weight[:, None, None], rate, delay, r, d)

    def turned() -> np.ndarray:
        return s * np.exp(-1j * TWO_PI * t * rho[:, None])[:, :, None] * np.exp(-1j * TWO_PI * nu * tau[:, None])[:, None, :]

    for _ in range(search.iterations):
        z = turned()
        by_nu, by_t = z.sum(1), z.sum(2)
        total = by_nu.sum(1)
        some = total != 0
        tau = tau + np.where(some, _slopes(by_nu, nu, total), 0.0) / TWO_PI
        rho = rho + np.where(some, _slopes(by_t, t, total), 0.0) / TWO_PI
    peak = turned().sum((1, 2))
    region = np.stack([_regions(g.shape[1:], int(a), int(b)) for a, b in zip(r, d)]) if n else np.zeros((0, 0), int)
    sigma = np.median(np.take_along_axis(by_column, region, 1), 1) / np.sqrt(2 * np.log(2)) if region.size else np.zeros(n)
    snr = np.where(sigma > 0, magnitude[np.arange(n), r, d] / np.where(sigma > 0, sigma, 1), 0.0)
    sure = (snr > 0) & (bandwidth > 0)
    return {
        "delay": tau, "rate": rho, "snr": snr, "sigma_delay": np.where(sure, 1 / (TWO_PI * np.where(sure, snr * bandwidth, 1)), np.inf),
        "re": peak.real / weight, "im": peak.imag / weight, "q11": q[:, 0, 0], "q12": q[:, 0, 1], "q22": q[:, 1, 1], "q_ab": np.abs(peak) ** 2 / weight,
        "delay_bin": np.full(n, float(delay[1] - delay[0]) if len(delay) > 1 else 1.0), "rate_bin": np.full(n, float(rate[1] - rate[0]) if len(rate) > 1 else 1.0),
    }


def measure(s: np.ndarray, tl: Lattice, fl: Lattice, t0: float, nu0: float, weight: float, bandwidth: float, search: Search) -> dict:
    """Peak of one plane: measure_many of it alone, phases referred to (t0, nu0)."""
    got = measure_many(s[None], tl, fl, (tl.points() - t0)[None], (fl.points() - nu0)[None], np.array([weight]), np.array([bandwidth]), search)
    return {k: float(v[0]) for k, v in got.items()}


def plane(s: np.ndarray, tl: Lattice, fl: Lattice, weight: float, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(|G| / D, rate, delay) of the whole window."""
    g, rate, delay = transform(s, tl, fl, search.rates, search.delays, search.oversample)
    return np.abs(g) / weight, rate, delay
