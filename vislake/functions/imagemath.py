"""Maps, CLEAN and restoring on one source's visibilities (I1-I6): NumPy kernels without Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TWO_PI = 2 * np.pi
#: Visibilities that are transformed at once.
BLOCK = 512
#: Components are restored out to this many full widths at half maximum of the major axis.
REACH = 4.0
FWHM = 2 * np.sqrt(2 * np.log(2))


@dataclass(frozen=True)
class Grid:
    """npix x npix pixels of `pixel` mas about pixel npix // 2; axis 0 is x (East), axis 1 is y (North)."""

    npix: int
    pixel: float

    def axis(self) -> np.ndarray:
        return (np.arange(self.npix) - self.npix // 2) * self.pixel

    def wide_axis(self) -> np.ndarray:
        return (np.arange(2 * self.npix - 1) - (self.npix - 1)) * self.pixel


def adjoint(u: np.ndarray, v: np.ndarray, z: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Sum of Re[z exp(-2 pi i (u x + v y))] on the grid, in blocks of visibilities as matrix products."""
    out = np.zeros((len(xs), len(ys)))
    for k in range(0, len(u), BLOCK):
        s = slice(k, k + BLOCK)
        ex = np.exp(-1j * TWO_PI * np.outer(xs, u[s])) * z[s]
        ey = np.exp(-1j * TWO_PI * np.outer(v[s], ys))
        out += ex.real @ ey.real - ex.imag @ ey.imag
    return out


def dirty_map(u, v, vis, w, grid: Grid) -> np.ndarray:
    """Weighted direct transform in Jy/beam."""
    if not np.sum(w) > 0:
        raise ValueError("total weight is zero")
    return adjoint(u, v, w * vis, grid.axis(), grid.axis()) / np.sum(w)


def dirty_beam(u, v, w, grid: Grid) -> np.ndarray:
    """The same of unit visibilities on the difference grid; 1 in its centre."""
    patch = adjoint(u, v, w.astype(complex), grid.wide_axis(), grid.wide_axis()) / np.sum(w)
    if not np.isclose(patch[grid.npix - 1, grid.npix - 1], 1):
        raise ValueError("the beam's centre is not 1: non-finite weights?")
    return patch


def beam_moments(u, v, w) -> tuple[float, float, float]:
    """(sigma of the major axis, minor/major, position angle) from weighted second moments."""
    m = np.array([[np.sum(w * a * b) for b in (u, v)] for a in (u, v)]) / np.sum(w)
    if not (m[0, 0] > 0 and m[1, 1] > 0 and np.linalg.det(m) > 0):
        raise ValueError("the uv coverage is a point or a line")
    val, vec = np.linalg.eigh(np.linalg.inv(TWO_PI**2 * m))
    return float(np.sqrt(val[1])), float(np.sqrt(val[0] / val[1])), float(np.arctan2(vec[0, 1], vec[1, 1]))


def hogbom(dirty: np.ndarray, patch: np.ndarray, gain: float, niter: int, threshold: float, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(flux per pixel, residual, iterations): CLEAN down to an absolute level, components inside the window only.

    The strongest pixel is the first in column-major order among equals. An empty window, a gain outside (0, 1] or a
    threshold not above 0 is an error.
    """
    n = dirty.shape[0]
    if not 0 < gain <= 1 or not threshold > 0 or (window is not None and not window.any()):
        raise ValueError("gain in (0, 1], threshold above 0 and a window that is not empty")
    # Transposed, so that the flat order in memory is the column-major one of the map; buffers are made once.
    work, turned = np.ascontiguousarray(dirty.T, float), np.ascontiguousarray(patch.T, float)
    shut = None if window is None else np.ascontiguousarray(~window.T)
    size, step = np.empty_like(work), np.empty_like(work)
    flux, used = np.zeros_like(dirty, float), 0
    for _ in range(niter):
        np.abs(work, out=size)
        if shut is not None:
            size[shut] = -1.0
        y, x = divmod(int(size.argmax()), n)
        peak = work[y, x]
        if abs(peak) < threshold:
            break
        flux[x, y] += gain * peak
        np.multiply(turned[n - 1 - y : 2 * n - 1 - y, n - 1 - x : 2 * n - 1 - x], gain * peak, out=step)
        np.subtract(work, step, out=work)
        used += 1
    residual = work.T.copy()
    return flux, residual, used


def restore(flux: np.ndarray, residual: np.ndarray, beam: tuple[float, float, float], grid: Grid) -> np.ndarray:
    """Components convolved with the Gaussian beam of unit peak, plus the residual (I4)."""
    sigma, ratio, pa = beam
    out, axis = residual.copy(), grid.axis()
    reach = REACH * FWHM * sigma
    for x, y in zip(*np.nonzero(flux)):
        a, b = np.abs(axis - axis[x]) <= reach, np.abs(axis - axis[y]) <= reach
        dx, dy = np.meshgrid(axis[a] - axis[x], axis[b] - axis[y], indexing="ij")
        along, across = dx * np.sin(pa) + dy * np.cos(pa), dx * np.cos(pa) - dy * np.sin(pa)
        out[np.ix_(a, b)] += flux[x, y] * np.exp(-0.5 * ((along / sigma) ** 2 + (across / (sigma * ratio)) ** 2))
    return out


def peak_position(image: np.ndarray, grid: Grid) -> tuple[float, float]:
    """Position of the maximum in mas, refined by parabolas through its neighbours."""
    y, x = divmod(int(image.ravel(order="F").argmax()), image.shape[0])

    def shift(m: float, c: float, p: float) -> float:
        d = m - 2 * c + p
        return float(np.clip((m - p) / (2 * d), -1, 1)) if d < 0 else 0.0

    n, axis = image.shape[0], grid.axis()
    dx = shift(image[x - 1, y], image[x, y], image[x + 1, y]) if 0 < x < n - 1 else 0.0
    dy = shift(image[x, y - 1], image[x, y], image[x, y + 1]) if 0 < y < n - 1 else 0.0
    return float(axis[x] + dx * grid.pixel), float(axis[y] + dy * grid.pixel)


def disk(dirty: np.ndarray, grid: Grid, radius: float) -> np.ndarray:
    """Window: a disk of the given radius in mas about the map's peak."""
    px, py = peak_position(np.abs(dirty), grid)
    x, y = np.meshgrid(grid.axis(), grid.axis(), indexing="ij")
    return (x - px) ** 2 + (y - py) ** 2 <= radius**2
