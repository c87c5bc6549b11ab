"""Solves under changed settings, masks and injections, and registration over model sets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.operators.estimate import DelayFit, Fit, constraints, fit
from vislake.session import cut

#: Solves that run at once; each is a series of small Spark jobs.
AT_ONCE = 4


def variant(observables: DataFrame, spec: DelayFit, **changes) -> Fit:
    """The same solve with some settings changed."""
    return fit(replace(spec, **changes), observables)


def _all(jobs: dict[str, Callable[[], Fit]]) -> dict[str, Fit]:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        futures = {k: pool.submit(f) for k, f in jobs.items()}
        return {k: f.result() for k, f in futures.items()}


def compare(a: Fit, b: Fit) -> pd.DataFrame:
    """Position differences per common source in mas, and in units of their combined sigma."""
    j = a.positions().merge(b.positions(), on="source", suffixes=("_a", "_b"))
    d_ra, d_dec = j["dra_mas_a"] - j["dra_mas_b"], j["ddec_mas_a"] - j["ddec_mas_b"]
    return pd.DataFrame({"source": j["source"], "dra_mas": d_ra, "ddec_mas": d_dec, "n_sigma_ra": d_ra / np.hypot(j["sigma_ra_mas_a"], j["sigma_ra_mas_b"]), "n_sigma_dec": d_dec / np.hypot(j["sigma_dec_mas_a"], j["sigma_dec_mas_b"])})


def split_solves(observables: DataFrame, spec: DelayFit) -> dict[str, tuple[Fit, Fit, pd.DataFrame]]:
    """Both halves of every standard split and their comparison: earlier/later, scans of odd/even number, slots.

    observables need scan besides the fit's columns. A split with an empty half is left out.
    """
    middle = observables.approxQuantile("t", [0.5], 1e-3)  # one number: halves need not be equal to the row
    o = cut(observables.withColumn("early", F.col("t") < F.lit(middle[0] if middle else 0.0)).withColumn("odd", F.col("scan") % 2 == 1))
    masks = {"time": "early", "scan": "odd", "slot": "slot = 1"}
    jobs = {}
    for name, m in masks.items():
        for half, e in (("a", m), ("b", f"NOT ({m})")):
            part = o.where(e).drop("early", "odd")
            if not part.isEmpty():
                jobs[f"{name}/{half}"] = lambda part=part: fit(spec, part)
    got = _all(jobs)
    return {n: (got[f"{n}/a"], got[f"{n}/b"], compare(got[f"{n}/a"], got[f"{n}/b"])) for n in masks if f"{n}/a" in got and f"{n}/b" in got}


def jackknife(observables: DataFrame, spec: DelayFit) -> dict[str, pd.DataFrame]:
    """Comparison with the full solve when each antenna but the reference is left out."""
    full = fit(spec, observables)
    o = cut(observables)
    jobs = {a: (lambda a=a: fit(spec, o.where((F.col("a1") != a) & (F.col("a2") != a)))) for a in full.layout.free}
    return {a: compare(full, f) for a, f in _all(jobs).items()}


def constraint_chi2(f: Fit) -> float:
    """Mean squared constraint residual in units of its sigma: tension between priors and data."""
    rows, w = constraints(f.spec, f.layout)
    return float((w * (rows @ f.x) ** 2).mean()) if len(rows) else 0.0


def stress(observables: DataFrame, spec: DelayFit, knobs: dict[str, Iterable]) -> pd.DataFrame:
    """One row per changed setting: chi2, wrms and the rms position change against the base."""
    base = fit(spec, observables)
    jobs = {f"{k}={v}": (lambda k=k, v=v: variant(observables, spec, **{k: v})) for k, values in knobs.items() for v in values}
    out = []
    for name, f in _all(jobs).items():
        d = compare(base, f)
        out.append((name, f.chi2, f.wrms, float(np.sqrt((d["dra_mas"] ** 2).mean())), float(np.sqrt((d["ddec_mas"] ** 2).mean()))))
    return pd.DataFrame(out, columns=["variant", "chi2", "wrms", "rms_ra_mas", "rms_dec_mas"])


def transfer(observables: DataFrame, spec: DelayFit, families: dict[str, list[DataFrame]]) -> pd.DataFrame:
    """How injected delays move positions (D7, A23): families: name -> list of (obs_id, injected) tables.

    Returned per family: mean and spread over its members of the rms position change in mas.
    """
    base = fit(spec, observables)
    jobs = {f"{n}/{k}": (lambda t=t: fit(spec, observables.join(t, "obs_id", "left").withColumn("tau_residual", F.col("tau_residual") + F.coalesce("injected", F.lit(0.0))).drop("injected"))) for n, ts in families.items() for k, t in enumerate(ts)}
    rms = {k: float(np.sqrt((compare(base, f)[["dra_mas", "ddec_mas"]] ** 2).to_numpy().mean())) for k, f in _all(jobs).items()}
    out = [(n, len(ts), float(np.mean([rms[f"{n}/{k}"] for k in range(len(ts))])), float(np.std([rms[f"{n}/{k}"] for k in range(len(ts))], ddof=1)) if len(ts) > 1 else float("nan")) for n, ts in families.items()]
    return pd.DataFrame(out, columns=["family", "n", "mean_mas", "std_mas"])


def _phase(*parts: Column) -> Column:
    """A phase in [0, 2 pi) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) * (2 * np.pi / (1 << 40))


def injection_families(observables: DataFrame, reps: int = 5, seed: int = 1, periodic_ps: float = 15.0, zenith_ps: float = 20.0, iono_scales: tuple[float, ...] = (-0.2, 0.2), modes: int = 200) -> DataFrame:
    """(family, label, obs_id, injected): delays in s to be added to residuals.

    diurnal and semidiurnal: a sinusoid per antenna with its own phase; iono_scale: a share of the ionospheric delay
    (tau_iono, if the table has it); zwd_turbulence: per antenna a sum of sinusoids over the table's span with amplitudes
    f^(-4/3) and own phases, put to the given rms and mapped with wet1, wet2. Phases are hashes of antenna, family, repetition
    and seed, so rows are made where they lie, in any order.
    """
    span = observables.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()  # two numbers
    if span["a"] is None:
        return observables.select(F.lit("").alias("family"), F.lit("").alias("label"), "obs_id", F.lit(0.0).alias("injected"))
    length = max(span["b"] - span["a"], 1.0)
    both = lambda f: f("a2") - f("a1")
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    parts = []
    for family, period in (("diurnal", 86400.0), ("semidiurnal", 43200.0)):
        wave = lambda a, family=family, period=period: periodic_ps * 1e-12 * F.sin(F.col("t") * (2 * np.pi / period) + _phase(F.col(a), F.lit(family), F.col("rep"), F.lit(seed)))
        parts.append(observables.select("obs_id", "a1", "a2", "t", rep).select(F.lit(family).alias("family"), F.concat_ws("#", F.lit(family), "rep").alias("label"), "obs_id", both(wave).alias("injected")))
    if "tau_iono" in observables.columns:
        for x in iono_scales:
            parts.append(observables.select(F.lit("iono_scale").alias("family"), F.lit(f"iono {x:+.0%}").alias("label"), "obs_id", (x * F.col("tau_iono")).alias("injected")))
    norm = zenith_ps * 1e-12 / np.sqrt(np.sum(np.arange(1, modes + 1) ** (-8 / 3)) / 2)
    k = F.sequence(F.lit(1), F.lit(modes))
    series = lambda a: F.aggregate(k, F.lit(0.0), lambda s, n: s + F.pow(n.cast("double"), F.lit(-4 / 3)) * F.cos(n * (F.col("t") - span["a"]) * (2 * np.pi / length) + _phase(F.col(a), n, F.lit("wet"), F.col("rep"), F.lit(seed)))) * norm
    wet = lambda a: F.col("wet" + a[-1]) * series(a)
    parts.append(observables.select("obs_id", "a1", "a2", "t", "wet1", "wet2", rep).select(F.lit("zwd_turbulence").alias("family"), F.concat_ws("#", F.lit("wet"), "rep").alias("label"), "obs_id", both(wet).alias("injected")))
    return reduce(DataFrame.unionByName, parts)


def split_transfer(observables: DataFrame, spec: DelayFit, families: dict[str, list[DataFrame]]) -> pd.DataFrame:
    """Injections carried through every standard split (D7): per family, repetition and split the rms of the split's position
    difference without and with the injection, and the rms of the change between the two, in mas. What drives a split's
    difference must change it by as much."""
    base = split_solves(observables, spec)
    rms = lambda d: float(np.sqrt((d[["dra_mas", "ddec_mas"]] ** 2).to_numpy().mean())) if len(d) else float("nan")
    out = []
    for name, tables in families.items():
        for k, t in enumerate(tables):
            moved = observables.join(t.select("obs_id", "injected"), "obs_id", "left").withColumn("tau_residual", F.col("tau_residual") + F.coalesce("injected", F.lit(0.0))).drop("injected")
            for split, (_, _, d) in split_solves(moved, spec).items():
                if split in base:
                    both = d.merge(base[split][2], on="source", suffixes=("", "_base"))
                    change = pd.DataFrame({c: both[c] - both[f"{c}_base"] for c in ("dra_mas", "ddec_mas")})
                    out.append((name, k, split, rms(base[split][2]), rms(d), rms(change)))
    return pd.DataFrame(out, columns=["family", "rep", "split", "base_mas", "injected_mas", "change_mas"])


def split_geometry(observables: DataFrame, by: str) -> DataFrame:
    """(source, half, n_obs, n_scans, t_span_h, el_span_deg) of both halves of a split, and of the thinner one per source as
    half NULL: what a subset loses (D7). by: a condition on the observables, as those of split_solves."""
    ends = F.array("el1", "el2")
    one = observables.withColumn("half", F.when(F.expr(by), "a").otherwise("b"))
    g = one.groupBy("source", "half").agg(F.count("*").alias("n_obs"), F.countDistinct("scan").alias("n_scans"), ((F.max("t") - F.min("t")) / 3600).alias("t_span_h"), F.degrees(F.max(F.array_max(ends)) - F.min(F.array_min(ends))).alias("el_span_deg"))
    thin = g.groupBy("source").agg(*[F.min(c).alias(c) for c in ("n_obs", "n_scans", "t_span_h", "el_span_deg")], F.count("*").alias("halves")).where("halves = 2")
    return g.unionByName(thin.select("source", F.lit(None).cast("string").alias("half"), "n_obs", "n_scans", "t_span_h", "el_span_deg"))


def application_scan(arms: dict[str, DataFrame], spec: DelayFit, reference: Callable[[Fit], dict] | None = None) -> pd.DataFrame:
    """One row per arm (an observable table of one way of applying a calibration): chi2, wrms, and the rms position difference
    of every standard split; with a reference its agreement too (D9)."""
    out = []
    for name, table in arms.items():
        f = fit(spec, table)
        row = {"arm": name, "chi2": f.chi2, "wrms": f.wrms, "n": f.rows.where("accepted").count()}
        for split, (_, _, d) in split_solves(table, spec).items():
            row[f"{split}_mas"] = float(np.sqrt((d[["dra_mas", "ddec_mas"]] ** 2).to_numpy().mean()))
        out.append(row | (reference(f) if reference else {}))
    return pd.DataFrame(out)


def turbulent(n: int, step: float, slope: float, rms: float, seed: int) -> np.ndarray:
    """A random series with a power-law spectrum and the given rms."""
    rng = np.random.default_rng(seed)
    f = np.fft.rfftfreq(n, step)
    amp = np.where(f > 0, np.where(f > 0, f, 1.0) ** (slope / 2), 0.0)
    x = np.fft.irfft(amp * (rng.normal(size=len(f)) + 1j * rng.normal(size=len(f))), n)
    return x * (rms / x.std()) if x.std() > 0 else x


def fraction_scan(rows: DataFrame, by: list[str], scales: Iterable[float], arms: dict[str, Column] | None = None) -> DataFrame:
    """(arm, by, scale, value): weighted rms of the residual when an installed calibration is applied at every scale.

    rows: by, residual, installed, w. arms: name -> condition on the rows (all rows if not given), for instance the ends of a
    baseline that have the cable signal and those that don't. One pass whatever the number of scales: sums of the three
    products give every scale's rms.
    """
    parts = []
    for name, condition in (arms or {"all": F.lit(True)}).items():
        s = rows.where(condition).groupBy(*by).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(n) for n, a, b in (("rr", "residual", "residual"), ("rc", "residual", "installed"), ("cc", "installed", "installed"))])
        parts.append(s.select(F.lit(name).alias("arm"), *by, "w", "rr", "rc", "cc"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    z = F.explode(F.array(*[F.lit(float(x)) for x in scales])).alias("scale")
    each = all_.select("*", z)
    return each.select("arm", *by, "scale", F.sqrt(F.greatest(F.try_divide(F.col("rr") - 2 * F.col("scale") * F.col("rc") + F.col("scale") ** 2 * F.col("cc"), F.col("w")), F.lit(0.0))).alias("value"))


def scan_minima(scan: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale, value): lowest point of every scan, moved to the vertex of the parabola through its neighbours in the
    squared value (D9)."""
    o = Window.partitionBy(*by).orderBy("scale")
    y = F.col("value") ** 2
    s = scan.withColumn("y", y).withColumns({"x0": F.lag("scale").over(o), "x2": F.lead("scale").over(o), "y0": F.lag("y").over(o), "y2": F.lead("y").over(o)})
    best = s.groupBy(*by).agg(F.min_by(F.struct("scale", "y", "value", "x0", "x2", "y0", "y2"), F.struct("y", "scale")).alias("__b")).select(*by, "__b.*")
    d1, d2 = F.try_divide(F.col("y") - F.col("y0"), F.col("scale") - F.col("x0")), F.try_divide(F.col("y2") - F.col("y"), F.col("x2") - F.col("scale"))
    curve = F.try_divide(d2 - d1, F.col("x2") - F.col("x0"))
    at = F.col("scale") - (d1 + curve * (F.col("scale") - F.col("x0"))) / (2 * curve)
    low = F.col("y") + (d1 + curve * (F.col("scale") - F.col("x0"))) * (at - F.col("scale")) + curve * (at - F.col("scale")) ** 2
    good = F.coalesce(curve > 0, F.lit(False))
    return best.select(*by, F.when(good, at).otherwise(F.col("scale")).alias("scale"), F.when(good, F.sqrt(F.greatest(low, F.lit(0.0)))).otherwise(F.col("value")).alias("value"))


def sign_regressions(rows: DataFrame, by: list[str], node_step: float) -> DataFrame:
    """(by, slope, n): slope of residual delay against installed delay after a piecewise linear clock is projected out of both
    (D8, F25). Near 1: the sign is right and the calibration was left out; near -1: applied with the wrong sign; near 0: applied.

    rows: by (a session's baseline), t, residual, installed. Clock nodes lie node_step apart from the group's first time. A
    group without a varying installed delay has NULL.
    """
    names = [f"{c} {t}" for c, t in rows.select(*by).dtypes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t"].to_numpy(float)
        nodes = t.min() + node_step * np.arange(max(int(np.ceil((t.max() - t.min()) / node_step)), 1) + 1)
        basis = np.maximum(0, 1 - np.abs((t[:, None] - nodes[None, :]) / node_step))
        clean = lambda y: y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
        x, y = clean(pdf["installed"].to_numpy(float)), clean(pdf["residual"].to_numpy(float))
        size = (x * x).sum()
        flat = size <= 1e-18 * (pdf["installed"] ** 2).sum()
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "slope": [None if flat else float((x * y).sum() / size)], "n": [len(pdf)]})

    good = F.col("t").isNotNull() & F.col("residual").isNotNull() & F.col("installed").isNotNull() & ~F.isnan("residual") & ~F.isnan("installed")
    return rows.where(good).select(*by, "t", "residual", "installed").groupBy(*by).applyInPandas(run, ", ".join(names) + ", slope double, n bigint")


def register(sets: dict[str, DataFrame], spec: DelayFit) -> dict[str, dict]:
    """Every model set's solve with its censuses; the reference (first) is solved again on the rows that a set kept where
    that set lost rows to wrapped structure (N11, P18).

    sets: label -> observables (wrapped rows have NaN residuals). Returned per set: fit, positions, matched (the reference
    fit on the same rows), n_wrapped, sources and baselines (DataFrames of counts and wrms).
    """
    labels = list(sets)
    reference = fit(spec, sets[labels[0]])
    out = {}
    for name in labels:
        o = sets[name]
        f = reference if name == labels[0] else fit(spec, o)
        lost = o.where(F.isnan("tau_residual"))
        n = lost.count()
        matched = reference if not n else fit(spec, sets[labels[0]].join(lost.select("obs_id"), "obs_id", "left_anti"))
        ok = f.rows.where("accepted")
        wrms = F.sqrt(F.sum(F.col("weight") * F.col("residual") ** 2) / F.sum("weight")).alias("wrms")
        out[name] = {"fit": f, "positions": f.positions().assign(model_set=name), "matched": matched, "n_wrapped": n, "sources": ok.groupBy("source").agg(F.count("*").alias("n"), wrms), "baselines": ok.groupBy("a1", "a2").agg(F.count("*").alias("n"), wrms)}
    return out


def fit_summary(sets: dict[str, dict]) -> pd.DataFrame:
    """One row per model set."""
    rows = [(n, r["fit"].chi2, r["fit"].wrms * 1e12, r["fit"].ndof, r["fit"].how, r["n_wrapped"]) for n, r in sets.items()]
    return pd.DataFrame(rows, columns=["model_set", "chi2", "wrms_ps", "ndof", "factorization", "n_wrapped"])


def fit_baselines(sets: dict[str, dict]) -> DataFrame:
    """(model_set, a1, a2, n, wrms): accepted rows and wrms of every baseline in every model set's solve."""
    parts = [r["baselines"].select(F.lit(n).alias("model_set"), "a1", "a2", "n", "wrms") for n, r in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def selected_counts(sets: dict[str, dict]) -> DataFrame:
    """(model_set, source, n_selected, n_accepted): rows that a solve took in, and those it kept."""
    parts = [r["fit"].rows.groupBy("source").agg(F.count("*").alias("n_selected"), F.count_if("accepted").alias("n_accepted")).withColumn("model_set", F.lit(n)) for n, r in sets.items()]
    return reduce(DataFrame.unionByName, parts).select("model_set", "source", "n_selected", "n_accepted")
