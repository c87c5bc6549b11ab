"""Solves on the graph of nodes (antenna, slot) joined by measured edges (C10, C11, M15): NumPy kernels without Spark."""

from __future__ import annotations

import numpy as np

SNR_WEIGHTED, CURVATURE_WEIGHTED = "snr", "curvature"


def node_of(p: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Number of the node (antenna from 1, slot 1 or 2), from 1."""
    return 2 * (np.asarray(p) - 1) + np.asarray(i)


def components(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Connected components of the edges a-b, each as its sorted node numbers, by their smallest node."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]  # pointer jumping: logarithmic rounds
        if np.array_equal(low, label):
            break
        label = low
    return [names[label == k] for k in np.unique(label)]


def gains(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray, weight: np.ndarray, iterations: int, model: np.ndarray | float = 1.0) -> np.ndarray:
    """Node gains g with value = g[a] model conj(g[b]) by simultaneous updates from ones; every second iterate is averaged
    with the one before. A node without weight keeps its value."""
    g = np.ones(n, complex)
    for k in range(1, iterations + 1):
        old = g
        za, zb = model * np.conj(old[b]), np.conj(model) * np.conj(old[a])
        num = np.bincount(a, weight * (np.conj(za) * value).real, n) + np.bincount(b, weight * (np.conj(zb) * np.conj(value)).real, n)
        num = num + 1j * (np.bincount(a, weight * (np.conj(za) * value).imag, n) + np.bincount(b, weight * (np.conj(zb) * np.conj(value)).imag, n))
        den = np.bincount(a, weight * np.abs(za) ** 2, n) + np.bincount(b, weight * np.abs(zb) ** 2, n)
        g = np.where(den > 0, num / np.where(den > 0, den, 1), old)
        if k % 2 == 0:
            g = (g + old) / 2
    return g


def scalar_solve(n: int, a: np.ndarray, b: np.ndarray, measured: np.ndarray, weight: np.ndarray, anchor: int) -> np.ndarray:
    """Node values x with measured = x[a] - x[b], weighted; x[anchor] = 0."""
    lap = np.zeros((n, n))
    np.add.at(lap, (a, a), weight)
    np.add.at(lap, (b, b), weight)
    np.add.at(lap, (a, b), -weight)
    np.add.at(lap, (b, a), -weight)
    rhs = np.bincount(a, weight * measured, n) - np.bincount(b, weight * measured, n)
    keep = np.arange(n) != anchor
    x = np.zeros(n)
    if keep.any():
        x[keep] = np.linalg.solve(lap[np.ix_(keep, keep)], rhs[keep])
    return x


def block_solve(n: int, a: np.ndarray, b: np.ndarray, rate: np.ndarray, delay: np.ndarray, q: np.ndarray, anchor: int, rate_bin: float, delay_bin: float) -> tuple[np.ndarray, np.ndarray]:
    """(rate, delay) of the nodes with 2x2 curvature weights q[edge] over (rate, delay), in units of the bin widths."""
    unit = np.array([rate_bin, delay_bin])
    lap, rhs = np.zeros((n, 2, n, 2)), np.zeros((n, 2))
    w = q * np.outer(unit, unit)[None]
    m = np.stack([rate / rate_bin, delay / delay_bin], axis=1)
    for e, (x, y) in enumerate(zip(a, b)):
        lap[x, :, x] += w[e]
        lap[y, :, y] += w[e]
        lap[x, :, y] -= w[e]
        lap[y, :, x] -= w[e]
        rhs[x] += w[e] @ m[e]
        rhs[y] -= w[e] @ m[e]
    keep = np.arange(n) != anchor
    full = lap[keep][:, :, keep].reshape(2 * keep.sum(), -1)
    if len(full) and np.linalg.matrix_rank(full) < len(full):
        raise ValueError("curvature solve is singular: delay or rate has no curvature on these edges")
    x = np.zeros((n, 2))
    if len(full):
        x[keep] = np.linalg.solve(full, rhs[keep].ravel()).reshape(-1, 2)
    return x[:, 0] * rate_bin, x[:, 1] * delay_bin


def stationize(edges: dict[str, np.ndarray], kind: str, iterations: int, reference: int, rate_bin: float = 1.0, delay_bin: float = 1.0) -> dict[str, np.ndarray]:
    """Node delays, rates and phases from edges p, i, q, j, delay, rate, re, im, snr, q11, q12, q22, q_ab (C11).

    Each connected component is solved on its own about its anchor: the lowest node of the reference antenna, else the
    lowest node. Returned per node: p, i, delay, rate, phase, component (its lowest node), anchored.
    """
    a, b = node_of(edges["p"], edges["i"]), node_of(edges["q"], edges["j"])
    out: dict[str, list] = {k: [] for k in ("p", "i", "delay", "rate", "phase", "component", "anchored")}
    for nodes in components(a, b):
        mine = np.isin(a, nodes)
        x, y = np.searchsorted(nodes, a[mine]), np.searchsorted(nodes, b[mine])
        e = {k: np.asarray(v)[mine] for k, v in edges.items()}
        own = nodes[(nodes + 1) // 2 == reference]
        anchor = int(np.searchsorted(nodes, own.min() if len(own) else nodes.min()))
        n = len(nodes)
        if kind == SNR_WEIGHTED:
            rate, delay, weight = scalar_solve(n, x, y, e["rate"], e["snr"], anchor), scalar_solve(n, x, y, e["delay"], e["snr"], anchor), e["snr"]
        else:
            q = np.stack([np.stack([e["q11"], e["q12"]], 1), np.stack([e["q12"], e["q22"]], 1)], 1)
            rate, delay = block_solve(n, x, y, e["rate"], e["delay"], q, anchor, rate_bin, delay_bin)
            weight = e["q_ab"]
        z = e["re"] + 1j * e["im"]
        g = gains(n, x, y, z / np.abs(z), weight, iterations)
        phase = np.angle(g * np.conj(g[anchor]) / abs(g[anchor]))
        for k, v in (("p", (nodes + 1) // 2), ("i", (nodes - 1) % 2 + 1), ("delay", delay), ("rate", rate), ("phase", phase), ("component", np.full(n, nodes.min())), ("anchored", np.full(n, len(own) > 0))):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.array([]) for k, v in out.items()}
