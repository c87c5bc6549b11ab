"""Fringe measurement and self-calibration on tiles.

Visibilities are first summed to (tile, baseline, slots, time, channel) cells by a hash aggregate, so that what a tile's
kernel gets is bounded by the tile's own grid and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, present
from vislake.functions.fringemath import Lattice, Search, assert_uniform, frequency_lattice, measure_many, plane, uniform_lattice
from vislake.functions.graphmath import stationize
from vislake.operators.gains import Solution
from vislake.session import bounded

#: Cells of the planes that are transformed as one stack.
STACK_CELLS = 1 << 19
#: Root mean square distance of times from their lattice, as a share of its step, from which they are not uniform.
UNIFORM_SHARE = 0.25

TILE = ["tcell", "fcell", "source", "p", "q"]
_PEAK = "delay double, rate double, snr double, sigma_delay double, re double, im double, q11 double, q12 double, q22 double, q_ab double, delay_bin double, rate_bin double"
FRINGES = f"tcell int, fcell int, source int, p int, q int, i int, j int, t double, nu double, weight double, bandwidth double, {_PEAK}"


def grid_sums(vis: DataFrame, strict: bool = True) -> DataFrame:
    """Sums of w V and w per cell of every tile's plane: TILE, i, j, t, nu, sre, sim, sw, n.

    strict: two present rows in one (baseline, slots, time, channel) are an error; otherwise they add up. A tile of
    several sources is an error in the kernel's check, because source is part of the key: see mixed_tiles.
    """
    good = vis.where(present(F.col("w")))
    g = good.groupBy(*TILE, "i", "j", "t", "nu").agg(F.sum(F.col("w") * F.col("re")).alias("sre"), F.sum(F.col("w") * F.col("im")).alias("sim"), F.sum("w").alias("sw"), F.count("*").alias("n"))
    if strict:
        g = g.withColumn("sw", F.when(F.col("n") > 1, F.raise_error(F.lit("two rows on one time and channel of a baseline"))).otherwise(F.col("sw")))
    return g


def mixed_tiles(vis: DataFrame) -> DataFrame:
    """Tiles (tcell, fcell, p, q) that hold more than one source; a fringe fit needs none."""
    return vis.where(present(F.col("w"))).groupBy("tcell", "fcell", "p", "q").agg(F.countDistinct("source").alias("n")).where("n > 1")


def statistics(sums: DataFrame) -> DataFrame:
    """(TILE, i, j, weight, bandwidth): D and the weighted rms of the frequency."""
    g = sums.groupBy(*TILE, "i", "j").agg(F.sum("sw").alias("weight"), F.sum(F.col("sw") * F.col("nu")).alias("m1"))
    mean = g.select(*TILE, "i", "j", "weight", (F.col("m1") / F.col("weight")).alias("nu_bar"))
    d = sums.join(mean, [*TILE, "i", "j"])
    return d.groupBy(*TILE, "i", "j").agg(F.first("weight").alias("weight"), F.sqrt(F.sum(F.col("sw") * (F.col("nu") - F.col("nu_bar")) ** 2) / F.first("weight")).alias("bandwidth"))


def _planes(pdf: pd.DataFrame, width: float, cadence: float | None):
    """Lattices of a tile and, per slot pair, its plane, weight and bandwidth."""
    t = np.unique(pdf["t"].to_numpy())
    tl = uniform_lattice(t) if cadence is None else Lattice(float(t[0]), cadence, int(np.rint((t[-1] - t[0]) / cadence)) + 1)
    assert_uniform(tl, t)
    fl = frequency_lattice(pdf["nu"].to_numpy(), width)
    for (i, j), g in pdf.groupby(["i", "j"], sort=True):
        s = np.zeros((tl.n, fl.n), complex)
        np.add.at(s, (tl.snap(g["t"].to_numpy()), fl.snap(g["nu"].to_numpy())), g["sre"].to_numpy() + 1j * g["sim"].to_numpy())
        w, nu = g["sw"].to_numpy(), g["nu"].to_numpy()
        mean = (w * nu).sum() / w.sum()
        yield tl, fl, int(i), int(j), s, float(w.sum()), float(np.sqrt((w * (nu - mean) ** 2).sum() / w.sum()))


def fringe_fit(vis: DataFrame, width: float, search: Search, strict: bool = True, cadence: float | None = None) -> DataFrame:
    """Peaks of every occupied (tcell, fcell, baseline, slots): FRINGES (C9). Nothing is gated.

    vis: tcell, fcell, source, p, q, i, j, t, nu, re, im, w; width: channel width in Hz; cadence: time step in s
    where it is known (else it is inferred from each tile's times, which must be uniform). A tile needs two times and two
    channels; one with fewer comes out with NULL peaks and its weight. Products without weight do not come out. Peak phases
    refer to the middle of the tile's times and frequencies. No rows: no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if not len(pdf):
                continue
            # Rows are sorted by tile: the last one may go on in the next batch.
            same = np.logical_and.reduce([pdf[k].to_numpy() == pdf[k].iloc[-1] for k in TILE])
            cut = int(np.argmax(same))
            held = pdf.iloc[cut:]
            if cut:
                yield _measured(pdf.iloc[:cut].reset_index(drop=True), width, search, cadence)
        if held is not None:
            yield _measured(held.reset_index(drop=True), width, search, cadence)

    return grid_sums(vis, strict).repartition(*TILE).sortWithinPartitions(*TILE, "i", "j").mapInPandas(run, FRINGES)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run of equal rows that each row is in, first row of each run) of columns in sorted order."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _measured(pdf: pd.DataFrame, width: float, search: Search, cadence: float | None) -> pd.DataFrame:
    """Peaks of many whole tiles: planes of equal shape and step are transformed as one stack."""
    col = {c: pdf[c].to_numpy() for c in (*TILE, "i", "j", "t", "nu", "sre", "sim", "sw")}
    tile, first = _runs(*[col[k] for k in TILE])
    t_lo, t_hi = np.minimum.reduceat(col["t"], first), np.maximum.reduceat(col["t"], first)
    f_lo, f_hi = np.minimum.reduceat(col["nu"], first), np.maximum.reduceat(col["nu"], first)
    enough = (t_hi > t_lo) & (f_hi > f_lo)
    origin, step = t_lo.astype(float), np.full(len(first), cadence or 1.0)
    n_t = np.ones(len(first), int)
    edge = np.append(first, len(pdf))
    if cadence is None:
        for k in np.flatnonzero(enough):
            lattice = uniform_lattice(col["t"][edge[k] : edge[k + 1]])
            origin[k], step[k], n_t[k] = lattice.origin, lattice.step, lattice.n
    else:
        n_t = np.rint((t_hi - t_lo) / cadence).astype(int) + 1
    order = np.lexsort((col["t"], tile))
    _, at = _runs(tile[order], col["t"][order])
    of, off = tile[order][at], col["t"][order][at] - origin[tile[order][at]]
    off = np.abs(off - np.rint(off / step[of]) * step[of])
    rms = np.sqrt(np.bincount(of, off * off, len(first)) / np.bincount(of, minlength=len(first)))
    if (enough & (rms > UNIFORM_SHARE * step)).any():
        raise ValueError(f"samples are not uniform: rms distance {rms[enough].max()}")
    n_f = np.rint((f_hi - f_lo) / width).astype(int) + 1
    away = lambda x: np.where(x < 0, np.ceil(x - 0.5), np.floor(x + 0.5)).astype(int)
    a = np.clip(away((col["t"] - origin[tile]) / step[tile]), 0, n_t[tile] - 1)
    b = np.clip(away((col["nu"] - f_lo[tile]) / width), 0, n_f[tile] - 1)
    plane_of, start = _runs(tile, col["i"], col["j"])
    mine = tile[start]
    weight = np.add.reduceat(col["sw"], start)
    mean = np.add.reduceat(col["sw"] * col["nu"], start) / weight
    spread = np.sqrt(np.add.reduceat(col["sw"] * (col["nu"] - mean[plane_of]) ** 2, start) / weight)
    ok = enough[mine]
    out = {k: col[k][start] for k in (*TILE, "i", "j")} | {"t": (t_lo + t_hi)[mine] / 2, "nu": (f_lo + f_hi)[mine] / 2, "weight": weight, "bandwidth": np.where(ok, spread, 0.0)}
    out |= {k: np.full(len(start), np.nan) for k in ("delay", "rate", "snr", "sigma_delay", "re", "im", "q11", "q12", "q22", "q_ab", "delay_bin", "rate_bin")}
    shapes: dict[tuple, list[int]] = {}
    for p in np.flatnonzero(ok):
        shapes.setdefault((n_t[mine[p]], n_f[mine[p]], step[mine[p]]), []).append(p)
    row_of = np.append(start, len(pdf))
    for (nt, nf, dt), every in shapes.items():
        most = max(1, STACK_CELLS // (nt * nf))
        for k in range(0, len(every), most):
            ps = np.array(every[k : k + most])
            rows = np.concatenate([np.arange(row_of[p], row_of[p + 1]) for p in ps])
            number = np.repeat(np.arange(len(ps)), row_of[ps + 1] - row_of[ps])
            s = np.zeros((len(ps), nt, nf), complex)
            np.add.at(s, (number, a[rows], b[rows]), col["sre"][rows] + 1j * col["sim"][rows])
            t = (origin[mine[ps]] - out["t"][ps])[:, None] + dt * np.arange(nt)[None, :]
            nu = (f_lo[mine[ps]] - out["nu"][ps])[:, None] + width * np.arange(nf)[None, :]
            for name, x in measure_many(s, Lattice(0.0, float(dt), int(nt)), Lattice(0.0, width, int(nf)), t, nu, weight[ps], out["bandwidth"][ps], search).items():
                out[name][ps] = x
    return pd.DataFrame(out)


def fringe_planes(vis: DataFrame, width: float, search: Search, strict: bool = True, cadence: float | None = None) -> DataFrame:
    """(TILE, i, j, rate, delay, magnitude): the whole search plane of every slot pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for tl, fl, i, j, s, w, _ in _planes(pdf, width, cadence):
            g, rate, delay = plane(s, tl, fl, w, search)
            r, d = np.meshgrid(rate, delay, indexing="ij")
            parts.append(pd.DataFrame({**{k: int(pdf[k].iloc[0]) for k in TILE}, "i": i, "j": j, "rate": r.ravel(), "delay": d.ravel(), "magnitude": g.ravel()}))
        return pd.concat(parts)

    return grid_sums(vis, strict).groupBy(*TILE).applyInPandas(run, "tcell int, fcell int, source int, p int, q int, i int, j int, rate double, delay double, magnitude double")


def peak_observables(fringes: DataFrame) -> DataFrame:
    """Diagonal products with a finite SNR, ungated."""
    return fringes.where((F.col("i") == F.col("j")) & F.col("snr").isNotNull() & ~F.isnan("snr"))


def edges(fringes: DataFrame, min_snr: float, pairs: Column | None = None) -> DataFrame:
    """Edges for a graph solve: positive weight, SNR at or above the gate, and the caller's predicate."""
    good = present(F.col("weight")) & F.coalesce(~F.isnan("snr") & (F.col("snr") >= min_snr), F.lit(False))
    return fringes.where(good if pairs is None else good & pairs)


def solve_nodes(fringes: DataFrame, kind: str, iterations: int, reference: int) -> DataFrame:
    """(tcell, fcell, nu, t, p, i, delay, rate, phase, component, anchored) of every tile's graph (C11).

    Edges go in order of (p, q, i, j), so sums do not depend on the cluster. A tile's graph is bounded by the number of
    antennas, not by the data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "q", "i", "j"], ignore_index=True)
        cols = {k: pdf[k].to_numpy() for k in ("p", "i", "q", "j", "delay", "rate", "re", "im", "snr", "q11", "q12", "q22", "q_ab")}
        got = stationize(cols, kind, iterations, reference, float(pdf["rate_bin"].median()), float(pdf["delay_bin"].median()))
        return pd.DataFrame({"tcell": int(pdf["tcell"].iloc[0]), "fcell": int(pdf["fcell"].iloc[0]), "nu": pdf["nu"].median(), "t": pdf["t"].median(), **got})

    return fringes.groupBy("tcell", "fcell").applyInPandas(run, "tcell int, fcell int, nu double, t double, p int, i int, delay double, rate double, phase double, component int, anchored boolean")


def fringe_self(solution: Solution, nodes: DataFrame, targets: list[str]) -> Solution:
    """Node corrections added to the target kinds (C12): the phase is carried to the cells' references and a common turn is
    taken out. The measurement's cells are the solution's own here (tcell, fcell)."""
    refs = nodes.join(bounded(solution.tcells.select(F.col("cell").alias("tcell"), F.col("ref").alias("t_ref"))), "tcell").join(bounded(solution.fcells.select(F.col("cell").alias("fcell"), F.col("ref").alias("nu_ref"))), "fcell")
    phase = F.col("phase")
    if "Delay" in targets:
        phase = phase + TWO_PI * F.col("delay") * (F.col("nu_ref") - F.col("nu"))
    if "Rate" in targets:
        phase = phase + TWO_PI * F.col("rate") * (F.col("t_ref") - F.col("t"))
    values = {"PhaseOffset": phase, "Delay": F.col("delay"), "Rate": F.col("rate")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), values[k].alias("value")) for k in targets])).alias("c")
    added = refs.select("p", "i", "tcell", "fcell", rows).select("c.kind", "p", "i", "tcell", "fcell", "c.value")
    total = solution.plus(added)
    turn = F.when(F.col("kind") == "PhaseOffset", F.col("value") - TWO_PI * F.rint(F.col("value") / TWO_PI)).otherwise(F.col("value"))
    touched = added.where("kind = 'PhaseOffset'").select("kind", "p", "i", "tcell", "fcell").distinct().withColumn("touched", F.lit(True))
    wrapped = total.components.join(touched, ["kind", "p", "i", "tcell", "fcell"], "left").withColumn("value", F.when(F.col("touched"), turn).otherwise(F.col("value"))).drop("touched")
    return Solution(wrapped, solution.tcells, solution.fcells)
