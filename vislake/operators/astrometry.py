"""Delay observables, registration and the catalogue."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.functions import delaymodel as dm
from vislake.functions.complexmath import TWO_PI
from vislake.operators.closure import model_visibility
from vislake.operators.residuals import slope, unwrapped
from vislake.operators.timejoin import horner, last_valid

MAS = dm.MAS


@dataclass(frozen=True)
class ModelContext:
    """What the a priori model needs: stations by name, Earth orientation and pressure series, TEC products.

    All are small constants of one session (a station has some hundred numbers, a TEC product a few MB) and travel to the
    tasks in the kernel's closure.
    """

    stations: dict[str, dm.Station]
    mjd0: float
    doy: float
    nu_eff: float
    eop: pd.DataFrame
    pressure: dict[str, tuple[np.ndarray, np.ndarray]]
    tec: dict[str, dm.TecMaps]
    primary: str
    inflation: float = 1.5
    terms: dm.Terms = dm.Terms()

    def orientation(self, mjd: np.ndarray) -> dict[str, np.ndarray]:
        """Cubic through four days for UT1 and polar motion, linear for the pole offsets."""
        x = self.eop["mjd"].to_numpy()
        if len(x) < 4 or mjd.min() < x[0] or mjd.max() > x[-1]:
            raise ValueError("epochs outside the Earth-orientation table")
        j = np.clip(np.searchsorted(x, mjd) - 2, 0, len(x) - 4)
        out = {}
        for c in ("ut1_utc", "xp", "yp"):
            y = self.eop[c].to_numpy()
            out[c] = sum(y[j + a] * np.prod([(mjd - x[j + b]) / (x[j + a] - x[j + b]) for b in range(4) if b != a], axis=0) for a in range(4))
        return out | {c: np.interp(mjd, x, self.eop[c]) for c in ("dx", "dy")}


def antenna_terms(keys: DataFrame, context: ModelContext) -> DataFrame:
    """Delay terms of every distinct (t, source, antenna): computed once and joined to both ends of baselines.

    keys: t, source, antenna, ra, dec. Returned besides: mjd, tau_geometric, tau_model (with hydrostatic troposphere), el,
    az, wet, grad, dtau_dra, dtau_ddec, iono (array of products, in name order).
    """
    names = sorted(context.tec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for name, g in b.groupby("antenna"):
                st = context.stations[name]
                day, frac = dm.split_mjd(context.mjd0, g["t"].to_numpy())
                mjd = day + frac
                d = dm.geometric_delay(st, g["ra"].to_numpy(), g["dec"].to_numpy(), day, frac, context.orientation(mjd), context.terms)
                lon, lat, height = dm.geodetic(st.xyz)
                t, p = context.pressure.get(name, (np.array([]), np.array([])))
                press = np.interp(g["t"], t, p) if len(t) else dm.standard_pressure(height)
                zhd = dm.zenith_hydrostatic(press, lat, height) / dm.C_LIGHT
                iono = np.stack([context.tec[k].slant_delay(st.xyz, mjd, d["az"], d["el"], context.nu_eff) for k in names], -1) if names else np.zeros((len(g), 0))
                parts.append(g[["t", "source", "antenna"]].assign(mjd=mjd, tau_geometric=d["tau"], tau_model=d["tau"] + zhd * dm.hydrostatic_mapping(d["el"], lat, height, context.doy), el=d["el"], az=d["az"], wet=dm.wet_mapping(d["el"], lat), grad=dm.gradient_mapping(d["el"]), dtau_dra=d["dtau_dra"], dtau_ddec=d["dtau_ddec"], iono=list(iono)))
            if parts:
                yield pd.concat(parts)

    numbers = "mjd, tau_geometric, tau_model, el, az, wet, grad, dtau_dra, dtau_ddec".replace(",", " double,") + " double"
    return keys.mapInPandas(run, f"t double, source string, antenna string, {numbers}, iono array<double>")


def applied_phase_delay(rows: DataFrame, applied: DataFrame) -> DataFrame:
    """(row_key, tau_applied): weighted slope over channels of the phase that calibration took out, q minus p, over 2 pi.

    rows: row_key, p, q, slot, tcell, chan, nu, w; applied: p, slot, tcell, chan, phase. No weight: 0.
    """
    side = lambda end: applied.select(F.col("p").alias(end), "slot", "tcell", "chan", F.col("phase").alias(f"ph_{end}"))
    j = rows.where(F.col("w") > 0).join(side("p"), ["p", "slot", "tcell", "chan"]).join(side("q"), ["q", "slot", "tcell", "chan"])
    s = slope(j.withColumn("phase", F.col("ph_q") - F.col("ph_p")), ["row_key"], "nu", "phase", "w")
    return rows.select("row_key").distinct().join(s, "row_key", "left").select("row_key", F.coalesce(F.col("slope") / TWO_PI, F.lit(0.0)).alias("tau_applied"))


def structure_delays(rows: DataFrame, models: DataFrame, wrap_threshold: float = math.pi / 2) -> DataFrame:
    """(row_key, tau_structure) from component models over every row's channels.

    rows: row_key, source, chan, nu, w, dtau_dra, dtau_ddec; models: source, components array<flux, x, y>. Sources without a
    model (or with an empty one) have 0; a phase step of wrap_threshold or more between kept channels gives NaN.
    """
    j = rows.where(F.col("w") > 0).join(models.where(F.size("components") > 0), "source")
    u, v = -F.col("nu") * MAS * F.col("dtau_dra"), -F.col("nu") * MAS * F.col("dtau_ddec")
    m = j.withColumn("phase", model_visibility(F.col("components"), u, v).angle()).select("row_key", "nu", "w", "phase")
    un = unwrapped(m, ["row_key"], "nu", "phase")
    from pyspark.sql import Window

    step = F.abs(F.col("unwrapped") - F.lag("unwrapped").over(Window.partitionBy("row_key").orderBy("nu")))
    g = un.withColumn("step", step)
    s = slope(g, ["row_key"], "nu", "unwrapped", "w").join(g.groupBy("row_key").agg(F.max("step").alias("worst")), "row_key")
    value = F.when(F.coalesce(F.col("worst") >= wrap_threshold, F.lit(False)), F.lit(float("nan"))).otherwise(F.coalesce(-F.col("slope") / TWO_PI, F.lit(0.0)))
    return rows.select("row_key").distinct().join(s.select("row_key", value.alias("t")), "row_key", "left").select("row_key", F.coalesce("t", F.lit(0.0)).alias("tau_structure"))


def correlator_delays(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Correlator delay and clock of (antenna, source, t) by the last valid record (J5, F16): NULL outside every interval.

    records: antenna, source, start, duration, gdelay (ascending coefficients in s, s/s ...), clock, dclock.
    """
    v = last_valid(queries, records, ["antenna", "source"], ["gdelay", "clock", "dclock"])
    dt = F.col("t") - F.col("start")
    return v.select("antenna", "source", "t", "row_key", horner(F.col("gdelay"), dt).alias("tau_correlator"), (F.col("clock") + F.col("dclock") * dt).alias("tau_clock"))


def total_delays(peaks: DataFrame, terms: DataFrame, correlator: DataFrame, applied: DataFrame | None, structure: DataFrame | None, context: ModelContext, add_back: bool = True) -> DataFrame:
    """The observable table (N10). peaks: obs_id, scan, source, a1, a2, slot, t, delay, rate, snr, sigma_delay, weight.

    tau_total = correlator (+ applied) - delay; tau_residual = tau_total - iono - structure - model + clock. Rows without a
    correlator interval have NULL totals, wrapped structure gives NaN; both drop out of the fit by themselves. Every lookup is
    an equi-join on (t, source, antenna) or obs_id; the terms were computed once per distinct key.
    """
    names = sorted(context.tec)
    cols = [c for c in terms.columns if c not in ("t", "source", "antenna")]
    end = lambda k: terms.select("t", "source", F.col("antenna").alias(f"a{k}"), *[F.col(c).alias(f"{c}{k}") for c in cols])
    cor = lambda k: correlator.select("t", "source", F.col("antenna").alias(f"a{k}"), F.col("tau_correlator").alias(f"cor{k}"), F.col("tau_clock").alias(f"clk{k}")).distinct()
    j = peaks
    for k in (1, 2):
        j = j.join(end(k), ["t", "source", f"a{k}"]).join(cor(k), ["t", "source", f"a{k}"], "left")
    one = lambda df, c: j.join(df.select(F.col("row_key").alias("obs_id"), c), "obs_id", "left") if df is not None else j.withColumn(c, F.lit(0.0))
    j = one(applied, "tau_applied")
    j = one(structure, "tau_structure")
    diffs = F.zip_with("iono2", "iono1", lambda a, b: a - b)
    at = names.index(context.primary) + 1 if names else 0
    n = len(names)
    mean = F.aggregate("__d", F.lit(0.0), lambda a, x: a + x) / max(n, 1)
    spread = F.sqrt(F.aggregate("__d", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))) / max(n - 1, 1))
    j = j.withColumn("__d", diffs).withColumn("__m", mean).withColumn("tau_iono", F.element_at("__d", at) if names else F.lit(0.0)).withColumn("sigma_iono", spread * context.inflation)
    total = F.col("cor2") - F.col("cor1") + (F.coalesce("tau_applied", F.lit(0.0)) if add_back else 0.0) - F.col("delay")
    j = j.withColumn("tau_correlator", F.col("cor2") - F.col("cor1")).withColumn("tau_clock", F.col("clk2") - F.col("clk1")).withColumn("tau_total", total)
    j = j.withColumn("tau_corrected", F.col("tau_total") - F.col("tau_iono") - F.coalesce("tau_structure", F.lit(0.0))).withColumn("tau_model", F.col("tau_model2") - F.col("tau_model1"))
    j = j.withColumn("tau_residual", F.col("tau_corrected") - F.col("tau_model") + F.col("tau_clock"))
    d = lambda c: (F.col(f"{c}2") - F.col(f"{c}1")).alias(c)
    return j.select("obs_id", "scan", "source", "a1", "a2", "slot", "t", F.col("mjd1").alias("mjd"), "tau_correlator", "tau_applied", "delay", "rate", "snr", F.col("sigma_delay").alias("sigma_tau"), "tau_total", "tau_iono", "sigma_iono", "tau_structure", "tau_corrected", "tau_model", "tau_clock", "tau_residual", "el1", "el2", "az1", "az2", "wet1", "wet2", "grad1", "grad2", d("dtau_dra"), d("dtau_ddec"))


def rotation_sums(offsets: DataFrame) -> DataFrame:
    """Sums of the normal equations of a rigid rotation (N13): offsets: ra, dec (rad), dra, ddec (any unit). One row."""
    sa, ca, sd, cd = F.sin("ra"), F.cos("ra"), F.sin("dec"), F.cos("dec")
    a, b = [-sd * ca, -sd * sa, cd], [sa, -ca, F.lit(0.0)]
    sums = [F.sum(a[i] * a[j] + b[i] * b[j]).alias(f"n{i}{j}") for i in range(3) for j in range(i, 3)]
    return offsets.agg(*sums, *[F.sum(a[i] * F.col("dra") + b[i] * F.col("ddec")).alias(f"y{i}") for i in range(3)], F.count("*").alias("n"))


def rotation_fit(offsets: DataFrame) -> np.ndarray:
    """Rotation about the three axes in the unit of the offsets."""
    s = rotation_sums(offsets).first()
    n = np.array([[s[f"n{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    return np.linalg.lstsq(n, np.array([s[f"y{i}"] for i in range(3)]), rcond=None)[0]


def error_model(rows: DataFrame, scales: list[float], floors: list[float], lost: int = 3) -> DataFrame:
    """One row (s, f, nll, chi2): likeliest scale and floor of sigma^2 = (s formal)^2 + f^2 + external^2 on a grid.

    rows: d, formal, external. The grid is a pair of literal lists, exploded per row and summed by a hash aggregate.
    """
    g = rows.select("d", "formal", "external", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("s")).select("*", F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("f"))
    v = (F.col("s") * F.col("formal")) ** 2 + F.col("f") ** 2 + F.col("external") ** 2
    nll = g.groupBy("s", "f").agg(F.sum(F.col("d") ** 2 / v + F.ln(v)).alias("nll"), F.sum(F.col("d") ** 2 / v).alias("q"), F.count("*").alias("n"))
    best = F.min_by(F.struct("s", "f", "nll", "q", "n"), F.struct("nll", "s", "f")).alias("b")
    return nll.agg(best).select("b.s", "b.f", "b.nll", (F.col("b.q") / F.greatest(F.col("b.n") - lost, F.lit(1))).alias("chi2"))


def catalogue(positions: DataFrame, infos: DataFrame, images: DataFrame, closures: DataFrame, reference: DataFrame) -> DataFrame:
    """Catalogue rows: left joins of everything known per (model_set, source) to the positions; attributes that are missing are
    NaN (J13, N16). infos, images, reference: per source; closures: per (model_set, source)."""
    out = positions.join(infos, "source", "left").join(images, "source", "left").join(closures, ["model_set", "source"], "left").join(reference, "source", "left")
    numeric = [c for c, t in out.dtypes if t == "double" and c not in positions.columns]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in numeric})


def strict_lookup(names: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each name exactly once in the table, else an error that names it."""
    n = table.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in table.columns if c != key])).alias("__r"))
    j = names.select(key).distinct().join(n, key, "left")
    bad = F.coalesce(F.col("__n"), F.lit(0)) != 1
    return j.select(F.when(bad, F.raise_error(F.concat(F.lit("not exactly once: "), F.col(key).cast("string")))).otherwise(F.col(key)).alias(key), "__r.*")


def displacement_floor(shifts: DataFrame, threshold: float) -> DataFrame:
    """(model_set, floor, n): median displacement of sources whose structure delay is about zero, per set and pooled as NULL
    (A30). shifts: model_set, source, shift, structure."""
    quiet = shifts.where(F.abs("structure") < threshold)
    return quiet.rollup("model_set").agg(F.median("shift").alias("floor"), F.count("*").alias("n"))


def horner_column(coefficients: Column, dt: Column) -> Column:
    """Polynomial of a model record (F16)."""
    return horner(coefficients, dt)
