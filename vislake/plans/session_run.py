"""A whole session: tables and partitions, averaged visibilities, imaging, registration, products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.functions.columns import absolute_position, dec_sexagesimal, ra_sexagesimal
from vislake.functions.delaymodel import Station, TecMaps
from vislake.functions.fringemath import Search
from vislake.functions.imagemath import Grid, disk
from vislake.operators.astrometry import ModelContext, antenna_terms, catalogue, correlator_delays, error_model, rotation_fit, structure_delays, total_delays
from vislake.operators.average import average, average_rows
from vislake.operators.closure import closure_amp_chi2, closure_chi2, edges, model_visibility, noise_scale, stokes_i, with_models
from vislake.operators.combine import band_plan, combine, in_time_order
from vislake.operators.estimate import Fit, fit
from vislake.operators.fringe import fringe_fit, peak_observables
from vislake.operators.gains import Solution, calibrate
from vislake.operators.imaging import components_of, fine_cell, gridded, hybrid, image_sources
from vislake.operators.partition import Partition, ScanStrategy, by_scan, by_window, frequency_mode, gap_scans, time_mode, whole_band
from vislake.operators.timejoin import unflagged
from vislake.operators.whatif import fit_summary, register
from vislake.plans.config import OwnImaging, PointSource, SessionConfig
from vislake.plans.schedule import alignment_step, pcal_step
from vislake.session import bounded, cut, stored
from vislake.sources import fits, sinks


@dataclass(frozen=True)
class Session:
    """Opened tables of one session with its partitions (S3)."""

    config: SessionConfig
    vis: DataFrame
    channels: DataFrame
    scans: Partition
    windows: Partition
    band: Partition
    tables: dict[str, DataFrame]


def open_session(spark: SparkSession, config: SessionConfig, channels: DataFrame, tables: tuple[str, ...] = ("FLAG", "PHASE-CAL", "SYSTEM_TEMPERATURE", "GAIN_CURVE"), scans: ScanStrategy | None = None) -> Session:
    """Visibilities with scan ids and frequencies, flagged rows left out, and the instrument tables that the file has.

    channels: chan, nu, if_id. A table that the file lacks is left out of `tables`. scans: how distinct times become scans
    (X10); by gaps of the settings and by source if not given.
    """
    vis = fits.load(spark, [config.visibilities])[config.visibilities]
    found = {}
    for name in tables:
        try:
            fits.find_table(config.visibilities, name)
        except ValueError:
            continue
        found[name] = fits.read_table(spark, config.visibilities, name)
    if "FLAG" in found:
        lists = found["FLAG"].select(F.explode("ants" if "ants" in found["FLAG"].columns else F.array("antenna_no")).alias("antenna"), (F.element_at("timerang", 1) * 86400.0).alias("r_lo"), (F.element_at("timerang", 2) * 86400.0).alias("r_hi")).where("antenna > 0")
        rows = vis.select("row_id", "p", "q", "t", "int_time").distinct().select(F.col("row_id").alias("row_key"), F.col("p").alias("a1"), F.col("q").alias("a2"), F.col("t").alias("lo"), (F.col("t") + F.col("int_time")).alias("hi"))
        vis = vis.join(unflagged(rows, lists, 600.0).select(F.col("row_key").alias("row_id")), "row_id", "left_semi")
    times = cut((scans or gap_scans(config.min_gap))(vis.select("t", "source").distinct()))
    vis = vis.join(times, ["t", "source"]).join(F.broadcast(channels.select("chan", "nu")), "chan")  # one row per channel
    # Converted once: everything after this reads the shared folder's columns instead of parsing the file again.
    vis = cut(vis.withColumn("i", F.when(F.col("prod").isin(1, 3), 1).otherwise(2)).withColumn("j", F.when(F.col("prod").isin(1, 4), 1).otherwise(2)))
    return Session(config, vis, channels, by_scan(vis.select("scan", "t").distinct()), by_window(channels), whole_band(channels), found)


def open_files(spark: SparkSession, files: dict[str, DataFrame], width: float, scans: ScanStrategy) -> tuple[DataFrame, DataFrame]:
    """(rows, vis) of several files of one observation, with scans (S2, J1, O1). files: path -> channels (chan, nu) of that file,
    whose setups must be disjoint or nested; width: channel width in Hz. rows are in the order of time; vis has the rows' ids,
    bands and scans."""
    loaded = fits.load(spark, list(files))
    named = {}
    for path, v in loaded.items():
        both = v.join(F.broadcast(files[path].select("chan", "nu")), "chan")  # one row per channel
        slots = {"i": F.when(F.col("prod").isin(1, 3), 1).otherwise(2), "j": F.when(F.col("prod").isin(1, 4), 1).otherwise(2)}
        named[path] = both.withColumns(slots).select("p", "q", "source", "t", "nu", "i", "j", "re", "im", "w", F.col("u_m").alias("u"), F.col("v_m").alias("v"), "int_time")
    rows, vis = combine(named, band_plan(files, width))
    rows = stored(rows)
    times = scans(rows.select("t", "source").distinct())
    return in_time_order(rows.join(times, ["t", "source"])), vis.join(times, ["t", "source"])


def with_cells(vis: DataFrame, time: Partition, frequency: Partition) -> DataFrame:
    """Visibilities with tcell and fcell of two partitions."""
    keys = [c for c in time.lookup.columns if c != "cell"]
    v = vis.join(time.lookup.withColumnRenamed("cell", "tcell"), keys)
    return v.join(F.broadcast(frequency.lookup.withColumnRenamed("cell", "fcell")), "chan")  # one row per channel


def calibrate_and_average(session: Session, solution: Solution) -> DataFrame:
    """Stokes-I data of calibrated, averaged visibilities (N12): source, p, q, scan, t, chan, u, v, re, im, w."""
    a = session.config.averaging
    own = calibrate(with_cells(session.vis, session.scans, session.windows), solution, solution.kinds()).drop("tcell", "fcell")
    times = time_mode(session.vis.select("scan", "t").distinct(), "custom", a.seconds)
    freqs = frequency_mode(session.channels, a.frequency)
    cells = with_cells(own, times, freqs)
    mean = average(cells)
    rows = average_rows(cells.groupBy("row_id", "source", "p", "q", "tcell", "scan").agg(F.sum("w").alias("w_row"), F.min("u_m").alias("u"), F.min("v_m").alias("v"), F.first("int_time").alias("int_time")))
    j = mean.join(rows, ["source", "p", "q", "tcell"]).join(times.cells.select(F.col("cell").alias("tcell"), F.col("ref").alias("t")), "tcell").join(F.broadcast(freqs.cells.select(F.col("cell").alias("fcell"), F.col("ref").alias("nu"))), "fcell")
    return stokes_i(j.select(F.col("tcell").alias("row_id"), "source", "p", "q", "scan", "t", F.col("fcell").alias("chan"), "nu", "i", "j", "u", "v", "re", "im", "w"))


def imaging_settings(own: OwnImaging, weight_scale: float) -> dict:
    """Arguments of the imaging operator."""
    return {"grid": Grid(own.npix, own.pixel), "gain": own.gain, "niter": own.niter, "sigmas": own.sigmas, "weight_scale": weight_scale, "window": lambda dirty, grid: disk(dirty, grid, own.window_radius)}


def own_images(stokes: DataFrame, own: OwnImaging, refit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Images of every source by the member's settings, with the hybrid loop if a refit is given (I8)."""
    k = noise_scale(stokes).first()["k"] or 1.0
    settings = imaging_settings(own, k)
    return hybrid(stokes, refit, own.hybrid_rounds, own.floor, **settings)[0] if refit else image_sources(gridded(stokes, fine_cell(settings["grid"])), **settings)



def closure_evaluation(stokes: DataFrame, model_sets: DataFrame, weight_scale: float, min_snr: float = 5.0) -> DataFrame:
    """(model_set, source, chi2_phase, n_phase, chi2_amp, rms_amp, n_amp) of every model set (A14). model_sets: model_set,
    source, components."""
    m = with_models(stokes, model_sets)
    z = model_visibility(F.col("components"), F.col("u"), F.col("v"))
    m = m.withColumn("model_re", z.re).withColumn("model_im", z.im).withColumn("source", F.struct("model_set", "source")).drop("components", "model_set")
    e = edges(m, weight_scale)
    a = closure_chi2(e, ["source"]).select("source", F.col("chi2").alias("chi2_phase"), F.col("n").alias("n_phase"))
    b = closure_amp_chi2(e, min_snr, ["source"]).select("source", F.col("chi2").alias("chi2_amp"), F.col("rms").alias("rms_amp"), F.col("n").alias("n_amp"))
    return a.join(b, "source", "left").select("source.model_set", "source.source", *[c for c in a.columns + b.columns if c != "source"])


def with_structure(observables: DataFrame, channels: DataFrame, models: DataFrame, wrap_threshold: float) -> DataFrame:
    """Observables of one model set: the structure delay of every row taken out of its residual."""
    rows = observables.select(F.col("obs_id").alias("row_key"), "source", "dtau_dra", "dtau_ddec")
    chans = [(r["chan"], r["nu"]) for r in channels.select("chan", "nu").orderBy("nu").collect()]  # one row per channel
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("chan"), F.lit(n).alias("nu")) for c, n in chans])).alias("c")
    full = rows.select("*", grid).select("row_key", "source", "dtau_dra", "dtau_ddec", "c.chan", "c.nu", F.lit(1.0).alias("w"))
    d = structure_delays(full, models, wrap_threshold).withColumnRenamed("row_key", "obs_id")
    return observables.join(d, "obs_id", "left").withColumn("tau_residual", F.col("tau_residual") - F.coalesce("tau_structure", F.lit(0.0)))


def register_sets(session: Session, observables: DataFrame, model_sets: dict[str, DataFrame | None]) -> dict[str, dict]:
    """Every model set's positions and censuses (N11); a set of None is the point-source one and should come first."""
    sets = {n: observables if m is None else cut(with_structure(observables, session.channels, m, session.config.wrap_threshold)) for n, m in model_sets.items()}
    return register(sets, session.config.delay_fit())


def uncertainty_model(positions: DataFrame, reference: DataFrame) -> dict[str, object]:
    """Frame rotation and error models against a reference catalogue (N15): offsets per source, rotation, scale and floor per
    coordinate. positions: source, dra_mas, ddec_mas, sigma_ra_mas, sigma_dec_mas, ra, dec; reference: source, ref_ra, ref_dec
    (mas about the same point), ref_sigma_ra, ref_sigma_dec."""
    j = cut(positions.join(reference, "source").withColumn("dra", F.col("dra_mas") - F.col("ref_ra")).withColumn("ddec", F.col("ddec_mas") - F.col("ref_dec")))
    scales, floors = [1.0 + 0.1 * k for k in range(31)], [0.01 * k for k in range(101)]
    models = {c: error_model(j.select(F.col(f"d{c}").alias("d"), F.col(f"sigma_{c}_mas").alias("formal"), F.col(f"ref_sigma_{c}").alias("external")), scales, floors).first().asDict() for c in ("ra", "dec")}
    fixed = {c: error_model(j.select(F.col(f"d{c}").alias("d"), F.col(f"sigma_{c}_mas").alias("formal"), F.col(f"ref_sigma_{c}").alias("external")), [1.5], floors).first().asDict() for c in ("ra", "dec")}
    return {"offsets": j.select("source", "dra", "ddec"), "rotation": rotation_fit(j.select("ra", "dec", "dra", "ddec")), "free": models, "fixed": fixed}


def reference_agreement(positions: DataFrame, reference: DataFrame) -> dict[str, object]:
    """Agreement with an external catalogue (N15): number of common sources, rms offsets in mas before and after a rigid
    rotation of the frame, and the rotation. positions and reference: as for uncertainty_model."""
    j = cut(positions.join(reference, "source").select("source", "ra", "dec", (F.col("dra_mas") - F.col("ref_ra")).alias("dra"), (F.col("ddec_mas") - F.col("ref_dec")).alias("ddec")))
    a = rotation_fit(j.select("ra", "dec", "dra", "ddec"))
    sa, ca, sd, cd = F.sin("ra"), F.cos("ra"), F.sin("dec"), F.cos("dec")
    left = {"ra": F.col("dra") - (-sd * ca * float(a[0]) - sd * sa * float(a[1]) + cd * float(a[2])), "dec": F.col("ddec") - (sa * float(a[0]) - ca * float(a[1]))}
    rms = lambda x: F.sqrt(F.avg(x * x))
    r = j.agg(F.count("*").alias("n"), rms(F.col("dra")).alias("rms_ra"), rms(F.col("ddec")).alias("rms_dec"), rms(left["ra"]).alias("rotated_ra"), rms(left["dec"]).alias("rotated_dec")).first().asDict()
    return r | {"rotation": a, "residuals": j.select("source", left["ra"].alias("dra"), left["dec"].alias("ddec"))}


# Columns of the published catalogue, in order.
CATALOGUE = (
    "source model_set kind jname ra_reference_deg dec_reference_deg ra_deg dec_deg ra_sex dec_sex dra_mas ddec_mas sigma_ra_formal_mas sigma_dec_formal_mas sigma_ra_final_mas sigma_dec_final_mas "
    "peak_ra_deg peak_dec_deg peak_x_mas peak_y_mas peak_from n_components n_components_total n_negative flux_model_jy flux_total_jy compactness r_max_mas jet_pa_deg jet_r_mas model_radius_mas "
    "peak_jy_beam residual_rms_mjy beam_maj_mas beam_min_mas beam_pa_deg image_npix image_pixel_mas tau_structure_median_ps tau_structure_max_ps n_wrap_excluded wrms_ps n_accepted n_selected "
    "chi2_closure_phase n_closure_phase chi2_closure_amp n_closure_amp image_file"
).split()


def catalogue_rows(positions: DataFrame, sources: DataFrame, facts: DataFrame, model: dict[str, float]) -> DataFrame:
    """The published table, 49 columns, one row per (source, model_set).

    positions: source, model_set, kind, dra_mas, ddec_mas, sigma_ra_mas, sigma_dec_mas. sources: source, jname, ra, dec (rad).
    facts: (source, model_set) and any of the other columns; what is missing is NaN, 0 or empty by its type. model: s,
    floor_ra_mas, floor_dec_mas of the error model. Positions are the reference ones moved by the fitted offsets, peaks those
    moved by peak_x_mas, peak_y_mas.
    """
    j = positions.join(sources.select("source", "jname", "ra", "dec"), "source", "left").join(facts, ["source", "model_set"], "left")
    fitted = absolute_position(F.col("dra_mas"), F.col("ddec_mas"), F.col("ra"), F.col("dec"))
    j = j.withColumn("__ra", fitted[0]).withColumn("__dec", fitted[1])
    if "peak_x_mas" in j.columns:
        peak = absolute_position(F.col("peak_x_mas"), F.col("peak_y_mas"), F.col("__ra"), F.col("__dec"))
    else:
        peak = (F.lit(float("nan")), F.lit(float("nan")))
    final = lambda c: F.sqrt((model["s"] * F.col(f"sigma_{c}_mas")) ** 2 + model[f"floor_{c}_mas"] ** 2)
    made = {
        "ra_reference_deg": F.degrees("ra"), "dec_reference_deg": F.degrees("dec"), "ra_deg": F.degrees("__ra"), "dec_deg": F.degrees("__dec"), "ra_sex": ra_sexagesimal(F.col("__ra")), "dec_sex": dec_sexagesimal(F.col("__dec")),
        "sigma_ra_formal_mas": F.col("sigma_ra_mas"), "sigma_dec_formal_mas": F.col("sigma_dec_mas"), "sigma_ra_final_mas": final("ra"), "sigma_dec_final_mas": final("dec"), "peak_ra_deg": F.degrees(peak[0]), "peak_dec_deg": F.degrees(peak[1]),
    }
    text = {"kind", "jname", "peak_from", "image_file", "source", "model_set", "ra_sex", "dec_sex"}

    def column(c: str) -> Column:
        value = made.get(c, F.col(c) if c in j.columns else F.lit(None))
        if c in text:
            return F.coalesce(value.cast("string"), F.lit("")).alias(c)
        if c.startswith("n_") or c == "image_npix":
            return F.coalesce(value.cast("bigint"), F.lit(0)).alias(c)
        return F.coalesce(value.cast("double"), F.lit(float("nan"))).alias(c)

    return j.select(*[column(c) for c in CATALOGUE])


def catalogue_metadata(session: Session, rows: DataFrame, model: dict[str, float], rotation: list[float], floors: DataFrame, sets: dict[str, dict[str, object]], more: dict[str, object] | None = None) -> dict[str, object]:
    """Facts that belong to the published table (N16): the session, its band, the error model, the rotation, the pooled and own
    floors of every model set (as of displacement_floor) with what each is and its number of rows."""
    band = session.channels.agg(F.count("*").alias("n"), F.min("nu").alias("lo"), F.max("nu").alias("hi"), F.sqrt(-F.var_pop("nu") / F.covar_pop("nu", 1 / F.col("nu"))).alias("eff")).first()
    count = {r["model_set"]: r["n"] for r in rows.groupBy("model_set").agg(F.count("*").alias("n")).collect()}  # one row per model set
    own = {r["model_set"]: r["floor"] for r in floors.collect()}
    return {
        "session": session.config.name, "n_channels": band["n"], "nu_eff_hz": band["eff"], "band_span_hz": band["hi"] - band["lo"], "n_sources": rows.select("source").distinct().count(), "n_model_sets": len(sets), "n_rows": sum(count.values()),
        "snr_gate": session.config.min_snr, "structure_wrap_rad": session.config.wrap_threshold, "ensemble_floor_mas": own.get(None), "frame_rotation_mas": [float(x) for x in rotation], "frame_rotation_removed": False, "sigma_final": dict(model),
        "model_sets": {n: {**facts, "n_rows": count.get(n, 0), "ensemble_floor_mas": own.get(n)} for n, facts in sets.items()}, **(more or {}),
    }


def assemble_context(geometry: DataFrame, eop: DataFrame, pressure: DataFrame | None, tec: dict[str, DataFrame], mjd0: float, channels: DataFrame, primary: str, inflation: float, codes: dict[str, int] | None = None) -> ModelContext:
    """All inputs of the a priori model in one context (S11): read_geometry, read_eop, pressure_series, read_tec_maps (one per
    product). Each is a constant of the session of bounded size (stations, days, one map product), so it may reach the driver.
    codes: station -> antenna number of the pressure series. A primary product that is not there, or Earth orientation that
    does not hold the session's day, is an error."""
    if tec and primary not in tec:
        raise ValueError(f"product {primary!r} of {sorted(tec)}")
    stations = {r["code"]: Station(np.array([r["x"], r["y"], r["z"]]), r["axis_offset"], np.array(r["amplitude"]).reshape(3, 11), np.array(r["phase"]).reshape(3, 11)) for r in geometry.collect()}
    days = eop.where(F.col("mjd").between(mjd0 - 5, mjd0 + 6)).orderBy("mjd").toPandas()
    if len(days) < 4:
        raise ValueError(f"no Earth orientation around MJD {mjd0}")
    series = {}
    if pressure is not None:
        by_number = {n: g.sort_values("t") for n, g in pressure.toPandas().groupby("antenna_no")}
        series = {c: (by_number[n]["t"].to_numpy(), by_number[n]["pressure"].to_numpy()) for c, n in (codes or {}).items() if n in by_number}
    maps = {}
    for name, df in tec.items():
        pdf = df.toPandas().sort_values(["mjd", "lat", "lon"])
        axes = [np.sort(pdf[c].unique()) for c in ("mjd", "lat", "lon")]
        shape = [len(a) for a in axes]
        maps[name] = TecMaps(*axes, pdf["tec"].to_numpy().reshape(shape), pdf["rms"].to_numpy().reshape(shape), float(pdf["base"].iloc[0]), float(pdf["height"].iloc[0]))
    band = channels.agg(F.sqrt(-F.var_pop("nu") / F.covar_pop("nu", 1 / F.col("nu"))).alias("eff"), F.avg("nu").alias("mean")).first()
    doy = float((pd.Timestamp("1858-11-17") + pd.Timedelta(days=mjd0)).dayofyear)
    return ModelContext(stations, mjd0, doy, band["eff"] or band["mean"], days, series, maps, primary, inflation)


def captured_applied_phase(instrument: Solution, channels: DataFrame, windows: DataFrame) -> DataFrame:
    """(p, slot, tcell, chan, phase): what the instrument's calibration took out of every channel, for applied_phase_delay (N9,
    F20). channels: chan, nu; windows: chan, fcell."""
    both = channels.select("chan", "nu").join(windows.select("chan", "fcell"), "chan").join(instrument.fcells.select(F.col("cell").alias("fcell"), F.col("ref").alias("nu_ref")), "fcell")
    c = instrument.components.where(F.col("kind").isin("PhaseOffset", "PhaseBandpass", "Delay")).join(bounded(both), "fcell")
    phase = F.when(F.col("kind") == "Delay", 2 * math.pi * F.col("value") * (F.col("nu") - F.col("nu_ref"))).otherwise(F.col("value"))
    return c.groupBy("p", F.col("i").alias("slot"), "tcell", "chan").agg(F.sum(phase).alias("phase"))


def observables(peaks: DataFrame, keys: DataFrame, correlator: DataFrame, context: ModelContext, applied: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """The observable table of a session's peaks (N9, N10): model terms once per distinct (t, source, antenna) of keys (with ra,
    dec), correlator delays by the last valid record, then total_delays."""
    terms = stored(antenna_terms(keys, context))
    found = correlator_delays(keys.select("antenna", "source", "t", F.lit(1).alias("row_key")), correlator)
    return total_delays(peaks, terms, found, applied, structure, context)


def solve(session: Session, table: DataFrame) -> Fit:
    """The session's solve with its own settings."""
    return fit(session.config.delay_fit(), table)


def instrumental(session: Session, zero: Solution, tones: DataFrame | None, alignment: DataFrame | None, gains: DataFrame | None) -> dict[str, Solution]:
    """The instrument's states in order (N12): none, tones (C15), alignment (C14), gains (kind LogAmplitudeBandpass, C16), each
    on top of the ones before; steps without input keep the state. Nothing is measured on the data here."""
    states, now = {"none": zero}, zero
    if tones is not None:
        now = pcal_step(tones, session.config.cable_apply, session.config.tone_floor)(session.vis, now)[0]
    states["tones"] = now
    if alignment is not None:
        now = alignment_step(alignment)(session.vis, now)[0]
    states["alignment"] = now
    if gains is not None:
        now = now.plus(gains.withColumn("kind", F.lit("LogAmplitudeBandpass")))
    return states | {"gains": now}


def fringe_states(session: Session, states: dict[str, Solution], width: float) -> dict[str, DataFrame]:
    """Peaks measured under every state of the instrument (N12, D9), per scan and window."""
    cells = with_cells(session.vis, session.scans, session.windows)
    return {n: fringe_fit(calibrate(cells, s, s.kinds()), width, session.config.search, strict=False) for n, s in states.items()}


def instrumental_arms(vis: DataFrame, solution: Solution, scales: tuple[float, ...], width: float, search: Search, min_snr: float, strict: bool = True, cadence: float | None = None) -> DataFrame:
    """(arm, n, snr_median, detection): what fringes gain from the instrument's calibration at every scale, 1 applied, 0 not,
    -1 with the wrong sign (D9). vis: with tcell and fcell."""
    out = None
    for x in scales:
        s = solution.scaled(x)
        f = peak_observables(fringe_fit(calibrate(vis, s, s.kinds()) if x else vis, width, search, strict, cadence))
        row = f.agg(F.lit(float(x)).alias("arm"), F.count("*").alias("n"), F.median("snr").alias("snr_median"), F.avg((F.col("snr") >= min_snr).cast("double")).alias("detection"))
        out = row if out is None else out.unionByName(row)
    return out


def expanded_models(config: SessionConfig, external: dict[str, DataFrame], own: dict[str, DataFrame]) -> DataFrame:
    """(model_set, source, components) of every model set that the settings name, variants included (I9). external and own:
    label -> (source, components); the point source's set has no models. A set without its table is an error."""
    out = None
    for label in config.model_sets():
        table = external.get(label, own.get(label))
        if table is None:
            if any(isinstance(m, PointSource) and m.label == label for m in config.members):
                continue
            raise ValueError(f"no models for {label!r}")
        part = table.select(F.lit(label).alias("model_set"), "source", "components")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("only a point-source set: nothing to expand")
    return out


def products(spark: SparkSession, session: Session, results: dict[str, dict], images: DataFrame | None, infos: DataFrame, closures: DataFrame, reference: DataFrame, folder: str) -> dict[str, object]:
    """Write the products that the settings ask for, in dependency order (K8); returns what each made."""
    made: dict[str, object] = {}
    wanted = session.config.products
    positions = spark.createDataFrame(pd.concat([r["positions"] for r in results.values()], ignore_index=True))
    cat = catalogue(positions, infos, images.select("source", "peak", "rms", "sigma_major") if images is not None else infos.select("source").limit(0).withColumn("peak", F.lit(None).cast("double")), closures, reference)
    if "catalogue" in wanted:
        made["catalogue"] = sinks.write_catalogue(cat, folder, {"dra_mas": "mas", "ddec_mas": "mas", "sigma_ra_mas": "mas", "sigma_dec_mas": "mas"}, {"session": session.config.name, "model_sets": list(results)}, ["source", "model_set"])
    if "fit_tables" in wanted:
        summary = spark.createDataFrame(fit_summary(results))
        sinks.write_table(summary, f"{folder}/fits")
        made["fit_tables"] = summary
    if "wcs" in wanted and images is not None:
        placed = images.join(infos.select("source", "ra_deg", "dec_deg"), "source")
        made["wcs"] = cut(sinks.write_images(placed, f"{folder}/images", session.config.name, [f"session {session.config.name}"]))
    if "closure" in wanted:
        sinks.write_table(closures, f"{folder}/closure")
        made["closure"] = closures
    if "report" in wanted:
        made["report"] = sinks.write_report(folder, session.config.name, {"model sets": ", ".join(results)}, {"fits": spark.createDataFrame(fit_summary(results))})
    if "manifest" in wanted:
        made["manifest"] = sinks.write_manifest(folder, {"session": session.config.name, "reference_antenna": session.config.reference_antenna})
    return made


__all__ = ["Session", "calibrate_and_average", "closure_evaluation", "components_of", "open_session", "own_images", "products", "register_sets", "uncertainty_model", "with_cells", "with_structure"]
