"""Global weighted least squares for positions, clocks and troposphere.

The normal matrix is accumulated per Arrow batch and summed; its size is that of the parameters, not of the data. Residuals
and per-baseline noise floors stay distributed: only parameters, floors (one number a baseline) and counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.session import cut

MAS = math.radians(1e-3 / 3600)
#: Largest number of parameters a fit may have (a dense normal matrix of this size is 128 MB).
MOST_PARAMETERS = 4000
#: Numbers in one piece of a normal matrix (256 KB).
PIECE = 1 << 15
#: Relative width of the steps in which variances of a baseline are brought together for its floor.
VARIANCE_STEP = 1e-4
#: Rows whose dense design is held at once (32 MB at the most parameters).
ROWS = 1024


@dataclass(frozen=True)
class DelayFit:
    """Settings of the fit (N1); units are seconds, radians and Hz."""

    reference_antenna: str
    reference_slot: int = 1
    elevation_cutoff: float = math.radians(7.0)
    min_snr: float = 7.0
    clock_node: float = 3600.0
    zwd_node: float = 3600.0
    clock_rate_constraint: float = 1e-13
    zwd_rate_constraint: float = 1e-14
    gradient_constraint: float = 2e-12
    reweight: bool = True
    reject: bool = True
    outlier_nsigma: float = 5.0
    robust_iterations: int = 8
    sigma_floor_init: float = 1e-11
    min_baseline_obs: int = 8
    gn_iterations: int = 1


@dataclass(frozen=True)
class Layout:
    """Columns of the design (N2): two per source, clock nodes and a slot offset per free antenna, wet-delay nodes and two
    gradients per antenna."""

    sources: list[str]
    antennas: list[str]
    free: list[str]
    clock_nodes: np.ndarray
    zwd_nodes: np.ndarray

    @staticmethod
    def of(spec: DelayFit, sources: list[str], antennas: list[str], t0: float, t1: float) -> Layout:
        if spec.reference_antenna not in antennas:
            raise ValueError(f"reference antenna {spec.reference_antenna} is not in the data")
        nodes = lambda step: t0 + step * np.arange(max(math.ceil((t1 - t0) / step), 1) + 1)
        out = Layout(sorted(sources), sorted(antennas), [a for a in sorted(antennas) if a != spec.reference_antenna], nodes(spec.clock_node), nodes(spec.zwd_node))
        if out.n > MOST_PARAMETERS:
            raise ValueError(f"{out.n} parameters; at most {MOST_PARAMETERS}")
        return out

    @property
    def starts(self) -> dict[str, int]:
        """First column of each block."""
        s = {"source": 0}
        s["clock"] = 2 * len(self.sources)
        s["slot"] = s["clock"] + len(self.free) * len(self.clock_nodes)
        s["zwd"] = s["slot"] + len(self.free)
        s["gradient"] = s["zwd"] + len(self.antennas) * len(self.zwd_nodes)
        return s

    @property
    def n(self) -> int:
        return self.starts["gradient"] + 2 * len(self.antennas)

    def names(self) -> list[str]:
        """A name per column."""
        out = [f"{what}[{s}]" for s in self.sources for what in ("ra", "dec")]
        out += [f"clock[{a},{k + 1}]" for a in self.free for k in range(len(self.clock_nodes))] + [f"slot[{a}]" for a in self.free]
        return out + [f"zwd[{a},{k + 1}]" for a in self.antennas for k in range(len(self.zwd_nodes))] + [f"{g}[{a}]" for a in self.antennas for g in ("gradient_n", "gradient_e")]


def _nodes(nodes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower node and share of the upper one for piecewise linear functions."""
    j = np.clip(np.searchsorted(nodes, t, "right") - 1, 0, len(nodes) - 2)
    return j, (t - nodes[j]) / (nodes[j + 1] - nodes[j])


def design(pdf: pd.DataFrame, layout: Layout, reference_slot: int) -> np.ndarray:
    """Dense design rows of a batch: tau_residual = row . x."""
    n, s = len(pdf), layout.starts
    a = np.zeros((n, layout.n))
    rows = np.arange(n)
    src = np.searchsorted(layout.sources, pdf["source"])
    a[rows, 2 * src], a[rows, 2 * src + 1] = pdf["dtau_dra"], pdf["dtau_ddec"]
    t = pdf["t"].to_numpy()
    jc, uc = _nodes(layout.clock_nodes, t)
    jz, uz = _nodes(layout.zwd_nodes, t)
    other = (pdf["slot"] != reference_slot).to_numpy(float)
    for end, sign in (("2", 1.0), ("1", -1.0)):
        names = pdf[f"a{end}"].to_numpy()
        free = np.searchsorted(layout.free, names)
        is_free = np.isin(names, layout.free)
        f, r = free[is_free], rows[is_free]
        at = s["clock"] + f * len(layout.clock_nodes) + jc[is_free]
        np.add.at(a, (r, at), sign * (1 - uc[is_free]))
        np.add.at(a, (r, at + 1), sign * uc[is_free])
        np.add.at(a, (r, s["slot"] + f), sign * other[is_free])
        ant = np.searchsorted(layout.antennas, names)
        at = s["zwd"] + ant * len(layout.zwd_nodes) + jz
        wet, grad, az = (pdf[f"{c}{end}"].to_numpy() for c in ("wet", "grad", "az"))
        np.add.at(a, (rows, at), sign * wet * (1 - uz))
        np.add.at(a, (rows, at + 1), sign * wet * uz)
        np.add.at(a, (rows, s["gradient"] + 2 * ant), sign * grad * np.cos(az))
        np.add.at(a, (rows, s["gradient"] + 2 * ant + 1), sign * grad * np.sin(az))
    return a


def constraints(spec: DelayFit, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of the pseudo-observations: clock and wet-delay rates and gradients about zero."""
    rows, sigma, s = [], [], layout.starts
    for block, names, nodes, width in (("clock", layout.free, layout.clock_nodes, spec.clock_rate_constraint), ("zwd", layout.antennas, layout.zwd_nodes, spec.zwd_rate_constraint)):
        for k in range(len(names)):
            for j, dt in enumerate(np.diff(nodes)):
                row = np.zeros(layout.n)
                row[s[block] + k * len(nodes) + j], row[s[block] + k * len(nodes) + j + 1] = -1 / dt, 1 / dt
                rows.append(row)
                sigma.append(width)
    for k in range(2 * len(layout.antennas)):
        row = np.zeros(layout.n)
        row[s["gradient"] + k] = 1.0
        rows.append(row)
        sigma.append(spec.gradient_constraint)
    return np.array(rows).reshape(-1, layout.n), 1 / np.array(sigma) ** 2


def solve_normal(n: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """(x, covariance, how): columns without data are fixed at 0, the rest is scaled; Cholesky, else eigenvalues above
    1e-10 of the largest (N4)."""
    n, rhs = n.copy(), rhs.copy()
    dead = np.diag(n) <= 0
    n[dead], n[:, dead], rhs[dead] = 0, 0, 0
    n[dead, dead] = 1
    scale = np.sqrt(np.diag(n))
    m = n / np.outer(scale, scale)
    try:
        low = np.linalg.inv(np.linalg.cholesky(m))
        inv, how = low.T @ low, "cholesky"
    except np.linalg.LinAlgError:
        val, vec = np.linalg.eigh(m)
        good = val > 1e-10 * val.max()
        inv, how = (vec[:, good] / val[good]) @ vec[:, good].T, "pseudoinverse"
    x, cov = inv @ (rhs / scale) / scale, inv / np.outer(scale, scale)
    x[dead], cov[dead], cov[:, dead] = 0, 0, 0
    return x, cov, how


def floor_variance(r: np.ndarray, var: np.ndarray, scale: float) -> float:
    """Variance to add so that mean r^2 / (var + v) equals scale; 0 if it is below already."""
    return floor_of_sums(r**2, var, len(r), scale)


def floor_of_sums(squares: np.ndarray, var: np.ndarray, n: int, scale: float) -> float:
    """The same from sums of r^2 over rows of one variance each; n: number of rows."""
    over = lambda v: (squares / (var + v)).sum() / n / scale - 1
    if over(0.0) <= 0:
        return 0.0
    low, high = 0.0, squares.sum() / n / max(scale, 1e-3)
    while over(high) > 0:
        high *= 4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) > 0 else (low, mid)
    return (low + high) / 2


def accepted(obs: DataFrame, spec: DelayFit) -> DataFrame:
    """Rows with finite residual, sigmas and snr, snr at the gate and both elevations above the cut (P20)."""
    ok = F.lit(True)
    for c in ("tau_residual", "sigma_tau", "sigma_iono", "snr"):
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return obs.where(ok & (F.col("snr") >= spec.min_snr) & (F.col("el1") >= spec.elevation_cutoff) & (F.col("el2") >= spec.elevation_cutoff))


@dataclass(frozen=True)
class Fit:
    """Result: parameters, covariance, per-row table (obs_id, residual, weight, kept, baseline), floors and log."""

    spec: DelayFit
    layout: Layout
    x: np.ndarray
    cov: np.ndarray
    rows: DataFrame
    floors: dict[tuple[str, str], float]
    chi2: float
    wrms: float
    ndof: int
    how: str
    log: list[dict] = field(default_factory=list)

    def positions(self) -> pd.DataFrame:
        """Offsets per source in mas with formal sigmas and correlation."""
        k = np.arange(len(self.layout.sources))
        ca, cd, cc = self.cov[2 * k, 2 * k], self.cov[2 * k + 1, 2 * k + 1], self.cov[2 * k, 2 * k + 1]
        sa, sd = np.sqrt(np.maximum(ca, 0)), np.sqrt(np.maximum(cd, 0))
        return pd.DataFrame({"source": self.layout.sources, "dra_mas": self.x[2 * k] / MAS, "ddec_mas": self.x[2 * k + 1] / MAS, "sigma_ra_mas": sa / MAS, "sigma_dec_mas": sd / MAS, "correlation": np.where((sa > 0) & (sd > 0), cc / np.where(sa * sd > 0, sa * sd, 1), 0.0)})

    def by_antenna(self, block: str) -> dict[str, np.ndarray]:
        """Values per antenna of the block clock, slot, zwd or gradient."""
        names = self.layout.free if block in ("clock", "slot") else self.layout.antennas
        width = {"clock": len(self.layout.clock_nodes), "slot": 1, "zwd": len(self.layout.zwd_nodes), "gradient": 2}[block]
        at = self.layout.starts[block]
        return {a: self.x[at + k * width : at + (k + 1) * width] for k, a in enumerate(names)}


_COLUMNS = ["obs_id", "source", "a1", "a2", "slot", "t", "tau_residual", "sigma_tau", "sigma_iono", "dtau_dra", "dtau_ddec", "wet1", "wet2", "grad1", "grad2", "az1", "az2"]


def _normal(obs: DataFrame, layout: Layout, spec: DelayFit, floors: dict) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Summed normal matrix, right side, number of rows and total weight of the rows with keep."""
    n = layout.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        big, rhs, count, weight = np.zeros((n, n)), np.zeros(n), 0, 0.0
        for pdf in (b.iloc[k : k + ROWS] for b in batches for k in range(0, len(b), ROWS)):
            pdf = pdf[pdf["keep"]]
            if len(pdf):
                a = design(pdf, layout, spec.reference_slot)
                w = 1 / (pdf["sigma_tau"] ** 2 + pdf["sigma_iono"] ** 2 + _floor(pdf, floors, spec)).to_numpy()
                big += (a * w[:, None]).T @ a
                rhs += a.T @ (w * pdf["tau_residual"].to_numpy())
                count += len(pdf)
                weight += w.sum()
        # The upper triangle in pieces: none is large, whatever the number of parameters.
        upper = big[np.triu_indices(n)]
        pieces = np.split(upper, np.arange(PIECE, len(upper), PIECE))
        for k, piece in enumerate(pieces):
            yield pd.DataFrame({"piece": [k], "values": [piece.tobytes()], "n": [0], "w": [0.0]})
        yield pd.DataFrame({"piece": [-1], "values": [rhs.tobytes()], "n": [count], "w": [weight]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that sums do not depend on the cluster.
        total = sum(np.frombuffer(b) for b in sorted(pdf["values"]))
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "values": [total.tobytes()], "n": [pdf["n"].sum()], "w": [pdf["w"].sum()]})

    kind = "piece int, values binary, n bigint, w double"
    # Partitions add up in two steps, so a task holds some dozens of copies of one piece and never a whole matrix.
    parts = obs.mapInPandas(run, kind).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("piece", "g").applyInPandas(lambda pdf: add(pdf), kind)
    got = {r["piece"]: r for r in some.groupBy("piece").applyInPandas(lambda pdf: add(pdf), kind).collect()}  # one triangle
    if not got:
        return np.zeros((n, n)), np.zeros(n), 0, 0.0
    big = np.zeros((n, n))
    big[np.triu_indices(n)] = np.concatenate([np.frombuffer(got[k]["values"]) for k in range(len(got) - 1)])
    return big + np.triu(big, 1).T, np.frombuffer(got[-1]["values"]), got[-1]["n"], got[-1]["w"]


def _floor(pdf: pd.DataFrame, floors: dict, spec: DelayFit) -> np.ndarray:
    """Added variance of every row's baseline."""
    low, high = np.minimum(pdf["a1"].astype(str), pdf["a2"].astype(str)), np.maximum(pdf["a1"].astype(str), pdf["a2"].astype(str))
    return np.array([floors.get((x, y), spec.sigma_floor_init**2) for x, y in zip(low, high)])


def _residuals(obs: DataFrame, layout: Layout, spec: DelayFit, floors: dict, x: np.ndarray) -> DataFrame:
    """obs with residual and var (measured variance without the floor) and floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[k : k + ROWS] for b in batches for k in range(0, len(b), ROWS)):
            r = pdf["tau_residual"].to_numpy() - design(pdf, layout, spec.reference_slot) @ x if len(pdf) else np.array([])
            yield pdf.assign(residual=r, var=pdf["sigma_tau"] ** 2 + pdf["sigma_iono"] ** 2, floor=_floor(pdf, floors, spec))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.schema.fields) + ", residual double, var double, floor double"
    return obs.mapInPandas(run, schema)


def _fit_once(spec: DelayFit, obs: DataFrame, layout: Layout) -> Fit:
    """Solve, residuals, floors, rejection with restoration, over and over."""
    extra, cw = constraints(spec, layout)
    floors: dict[tuple[str, str], float] = {}
    rows = obs.select(*_COLUMNS).withColumn("keep", F.lit(True))
    passes = spec.robust_iterations if spec.reweight or spec.reject else 0
    log = []
    for it in range(passes + 1):
        big, rhs, kept, total = _normal(rows, layout, spec, floors)
        x, cov, how = solve_normal(big + (extra * cw[:, None]).T @ extra, rhs)
        res = cut(_residuals(rows, layout, spec, floors, x))
        w = F.when(F.col("keep"), 1 / (F.col("var") + F.col("floor"))).otherwise(0.0)
        swr = res.agg(F.sum(w * F.col("residual") ** 2)).first()[0] or 0.0
        ndof = max(kept - layout.n + len(extra), 1)
        chi2, wrms = swr / ndof, math.sqrt(swr / total) if total else float("nan")
        log.append({"iteration": it, "chi2": chi2, "wrms": wrms, "kept": kept, "how": how})
        if it == passes:
            break
        if spec.reweight:
            scale = ndof / kept
            least = spec.min_baseline_obs

            def floor_of(pdf: pd.DataFrame) -> pd.DataFrame:
                n = int(pdf["n"].sum())
                return pd.DataFrame({"low": [pdf["low"].iloc[0]], "high": [pdf["high"].iloc[0]], "v": [floor_of_sums(pdf["s"].to_numpy(), pdf["var"].to_numpy(), n, scale)], "n": [n]})

            # Rows of one baseline whose variances agree to VARIANCE_STEP are one row with their mean variance, so that a baseline
            # is a bounded table however many rows it has. One number per baseline comes back: antennas^2 / 2 at most.
            base = res.where("keep").select(F.least("a1", "a2").alias("low"), F.greatest("a1", "a2").alias("high"), (F.col("residual") ** 2).alias("s"), "var")
            sums = base.groupBy("low", "high", F.floor(F.ln("var") / VARIANCE_STEP).alias("step")).agg(F.sum("s").alias("s"), F.avg("var").alias("var"), F.count("*").alias("n"))
            for r in sums.groupBy("low", "high").applyInPandas(floor_of, "low string, high string, v double, n bigint").collect():
                if r["n"] >= least:
                    floors[r["low"], r["high"]] = r["v"]
        rows = res.select(*_COLUMNS, "keep")
        if spec.reject:
            again = _residuals(rows, layout, spec, floors, x)
            rows = again.withColumn("keep", F.abs("residual") / F.sqrt(F.col("var") + F.col("floor")) < spec.outlier_nsigma).select(*_COLUMNS, "keep")
        rows = cut(rows)
    out = res.select("obs_id", "source", "a1", "a2", "slot", "t", "residual", w.alias("weight"), F.col("keep").alias("accepted"))
    names = {k: math.sqrt(v) for k, v in floors.items()}
    return Fit(spec, layout, x, cov, out, names, chi2, wrms, ndof, how, log)


def fit(spec: DelayFit, observables: DataFrame, relinearize: Callable[[dict], DataFrame] | None = None) -> Fit:
    """Positions, clocks, wet delays, gradients and slot offsets from delay observables.

    observables: the columns of _COLUMNS plus snr, el1, el2. relinearize gets accumulated offsets in radians per source and
    returns a new table of the same rows; gn_iterations linearisations are made then. No accepted row is an error.
    """
    obs = cut(accepted(observables, spec).select(*_COLUMNS, "snr", "el1", "el2"))
    facts = obs.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.collect_set("source").alias("s"), F.array_union(F.collect_set("a1"), F.collect_set("a2")).alias("a"), F.count("*").alias("n")).first()
    if not facts["n"]:
        raise ValueError("no observation passes acceptance")
    layout = Layout.of(spec, facts["s"], facts["a"], facts["t0"], facts["t1"])
    total = np.zeros(2 * len(layout.sources))
    for step in range(max(spec.gn_iterations, 1) if relinearize else 1):
        if step:
            offsets = {s: (total[2 * k], total[2 * k + 1]) for k, s in enumerate(layout.sources)}
            obs = cut(relinearize(offsets).join(obs.select("obs_id"), "obs_id", "left_semi"))
        result = _fit_once(spec, obs, layout)
        total += result.x[: len(total)]
    x = result.x.copy()
    x[: len(total)] = total
    return replace(result, x=x)


def fit_session(spec: DelayFit, pdf: pd.DataFrame) -> tuple[Layout, np.ndarray, np.ndarray, str]:
    """(layout, x, covariance, how) of one session's accepted rows, in memory; the steps of _fit_once. A session without the
    reference antenna gets its most observed one."""
    ends = pd.concat([pdf["a1"], pdf["a2"]])
    if spec.reference_antenna not in set(ends):
        spec = replace(spec, reference_antenna=min(ends.unique(), key=lambda a: (-(ends == a).sum(), a)))
    layout = Layout.of(spec, sorted(set(pdf["source"])), sorted(set(ends)), pdf["t"].min(), pdf["t"].max())
    extra, cw = constraints(spec, layout)
    prior = (extra * cw[:, None]).T @ extra
    a, tau, var = design(pdf, layout, spec.reference_slot), pdf["tau_residual"].to_numpy(), (pdf["sigma_tau"] ** 2 + pdf["sigma_iono"] ** 2).to_numpy()
    baseline = [(min(p), max(p)) for p in zip(pdf["a1"], pdf["a2"])]
    members: dict[tuple[str, str], list[int]] = {}
    for k, b in enumerate(baseline):
        members.setdefault(b, []).append(k)
    floor, keep = np.full(len(pdf), spec.sigma_floor_init**2), np.ones(len(pdf), bool)
    passes = spec.robust_iterations if spec.reweight or spec.reject else 0
    for it in range(passes + 1):
        w = np.where(keep, 1 / (var + floor), 0.0)
        x, cov, how = solve_normal((a * w[:, None]).T @ a + prior, a.T @ (w * tau))
        residual, kept = tau - a @ x, int(keep.sum())
        if it == passes or not kept:
            break
        if spec.reweight:
            scale = max(kept - layout.n + len(extra), 1) / kept
            for rows in members.values():
                good = [k for k in rows if keep[k]]
                if len(good) >= spec.min_baseline_obs:
                    floor[rows] = floor_variance(residual[good], var[good], scale)
        if spec.reject:
            keep = np.abs(residual) / np.sqrt(var + floor) < spec.outlier_nsigma
    return layout, x, cov, how


def fit_sessions(spec: DelayFit, observables: DataFrame) -> DataFrame:
    """Positions of every session by a fit of its own (N7): session, source, ra, dec (radians), c_rr, c_dd, c_rd, n, how.

    observables: those of fit with session. Sources without weight in a session are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "obs_id"], ignore_index=True)
        layout, x, cov, how = fit_session(spec, pdf)
        k = 2 * np.arange(len(layout.sources))
        n = pdf.groupby("source").size().reindex(layout.sources).to_numpy()
        out = pd.DataFrame({"session": pdf["session"].iloc[0], "source": layout.sources, "ra": x[k], "dec": x[k + 1], "c_rr": cov[k, k], "c_dd": cov[k + 1, k + 1], "c_rd": cov[k, k + 1], "n": n, "how": how})
        return out[(out["c_rr"] > 0) & (out["c_dd"] > 0)]

    return accepted(observables, spec).select("session", *_COLUMNS).groupBy("session").applyInPandas(run, "session string, source string, ra double, dec double, c_rr double, c_dd double, c_rd double, n bigint, how string")


def combine_positions(sessions: DataFrame) -> DataFrame:
    """The sessions' positions of a source, weighted by the inverse of their 2 x 2 covariances (those between sources are left
    out), in mas as in Fit.positions, with the number of sessions."""
    det = F.col("c_rr") * F.col("c_dd") - F.col("c_rd") ** 2
    good = det > 1e-12 * F.col("c_rr") * F.col("c_dd")
    s = sessions.where(good).select("source", "ra", "dec", (F.col("c_dd") / det).alias("a"), (-F.col("c_rd") / det).alias("b"), (F.col("c_rr") / det).alias("d"))
    g = s.groupBy("source").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("d").alias("d"), F.sum(F.col("a") * F.col("ra") + F.col("b") * F.col("dec")).alias("y"), F.sum(F.col("b") * F.col("ra") + F.col("d") * F.col("dec")).alias("z"), F.count("*").alias("n_sessions"))
    all_ = F.col("a") * F.col("d") - F.col("b") ** 2
    return g.select("source", ((F.col("d") * F.col("y") - F.col("b") * F.col("z")) / all_ / MAS).alias("dra_mas"), ((F.col("a") * F.col("z") - F.col("b") * F.col("y")) / all_ / MAS).alias("ddec_mas"), (F.sqrt(F.col("d") / all_) / MAS).alias("sigma_ra_mas"), (F.sqrt(F.col("a") / all_) / MAS).alias("sigma_dec_mas"), (-F.col("b") / F.sqrt(F.col("a") * F.col("d"))).alias("correlation"), "n_sessions")


def fit_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, wrms, robust sigma and share accepted over the fit's rows."""
    ok = F.col("accepted")
    r = F.when(ok, F.col("residual"))
    g = rows.groupBy(*(by or []))
    base = g.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"), F.sqrt(F.sum(F.col("weight") * F.col("residual") ** 2) / F.sum("weight")).alias("wrms"), F.median(r).alias("median"), F.max(F.abs(r)).alias("worst"))
    return base
