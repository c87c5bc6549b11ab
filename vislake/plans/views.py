"""Queries of views, look-ups, strategies, model terms and diagnostics (A3, A6, A7, A14, A21, A30, C13, D7-D9, D16, F9, F18, F20,
F25, G11, G12, I10, J6, J13-J15, N10, N12, N15, N16, P19, U5, U7, U8, W8, X1, X3, X9, X10)."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.dataset import Selection, select
from vislake.functions import delaymodel as dm
from vislake.operators import astrometry as ast
from vislake.operators import gains, whatif
from vislake.operators.average import average, average_rows, occupancy
from vislake.operators.estimate import MAS, DelayFit
from vislake.operators.gains import Solution, calibrate
from vislake.operators.imaging import amplitude_ratios, beam_matched_correlation, image_sources
from vislake.operators.partition import by_scan, frequency_mode, listed_scans, time_mode, whole
from vislake.operators.residuals import epoch_consistency, excursion, identifiability
from vislake.operators.verdicts import identifiability_verdicts
from vislake.plans import inspect as ui
from vislake.plans.common import CELLS_CTE, cells, r, vis, with_vis
from vislake.plans.session_run import catalogue_rows, closure_evaluation, instrumental_arms, reference_agreement
from vislake.plans.truths import _K, _PQ, CHANNELS, SEARCH, TIMES, _corrupted, _delays, _numbers, _points, _truth
from vislake.plans.visibility import _AVG, _ROWS, _ds, solution
from vislake.session import ensure_utc, finite, stored, table
from vislake.sources.adapters import DNU, NU0

# --- views -------------------------------------------------------------------------------------------------------------


def agg_a3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a window over the whole time, per channel."""
    g = ui.grid_data(vis(spark, sf_dir), None, float("-inf"), float("inf"))
    return g.select("p", "q", "chan", "i", "j", r(F.cos("phase"), 5).alias("cos_phase"), r(F.sin("phase"), 5).alias("sin_phase"), r("amp", 5).alias("amp"), r("w", 2).alias("w"))


def agg_a6_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of occupied cells over time, one line per node and window."""
    t = ui.traces(solution(spark), occupancy(cells(spark, sf_dir)), "Delay", "tcell")
    return t.select("p", "i", F.col("other").alias("fcell"), F.posexplode("points").alias("place", "point")).select("p", "i", "fcell", "place", F.col("point.x").alias("tcell"), r(F.col("point.y") * 1e9, 6).alias("delay_ns"))


def agg_a7_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antennas that were seen in the same sessions share a line."""
    o = table(spark, sf_dir, "observables").select(F.col("a1").alias("name"), F.substring("session", 3, 12).cast("double").alias("lo")).distinct()
    lines = ui.timelines(o.select("name", "lo", (F.col("lo") + 0.5).alias("hi")))
    return lines.select(F.array_min("names").alias("first_name"), F.size("names").alias("n_names"), F.size("cells").alias("n_cells"), F.element_at("cells", 1)["lo"].alias("first_lo"))


def ui_u8_displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays in display units, with the phase of a pair's solved delay."""
    ensure_utc(spark)
    return ui.displayed(solution(spark), "Delay").select("p", "i", "tcell", "fcell", r("value", 6).alias("value"), "unit")


def ui_u7_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual step of every scan of the dataset table."""
    d = table(spark, sf_dir, "dataset").select(F.concat_ws(":", "session", F.col("scan").cast("string")).alias("scan"), "t")
    return ui.cadence(d).select("scan", r("step", 6).alias("step"), "n")


def ui_u7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ui.slots_present(vis(spark, sf_dir))


def join_j15_uv_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure of merit against the averaged uv of its tile."""
    c = cells(spark, sf_dir)
    rows = average_rows(c.groupBy("row_id", "source", "p", "q", "tcell", "scan").agg(F.sum("w").alias("w_row"), F.min("u").alias("u"), F.min("v").alias("v"), F.lit(1.0).alias("int_time")))
    a = average(c).select("source", "p", "q", "tcell", "fcell", "i", "j", F.col("w").alias("snr"), F.lit(NU0).alias("nu"))
    joined, lost = ui.uv_snr(a, rows)
    both = joined.select("source", "p", "q", "tcell", "fcell", "i", "j", r("snr", 2).alias("snr"), r("uv_wavelengths", 1).alias("uv_wavelengths"))
    return both.unionByName(lost.select("source", "p", "q", "tcell", "fcell", "i", "j", r("snr", 2).alias("snr"), F.lit(None).cast("double").alias("uv_wavelengths")))


# --- selections, kinds, strategies -------------------------------------------------------------------------------------


def sel_x1_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a callable of the table and a list of channels."""
    s = select(_ds(spark, sf_dir), Selection(lambda v: (v["source"] % 2 == 0) & (v["t"] > 5e7), (1, 3, 6)))
    return s.vis.select("row_id", "p", "q", "source", "chan", "i", "j", r("re", 8).alias("re"))


def sel_p19_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities calibrated with half of a solution's delays."""
    half = Solution(solution(spark).of("Delay"), solution(spark).tcells, solution(spark).fcells).scaled(0.5)
    c = calibrate(cells(spark, sf_dir), half, half.kinds())
    return c.select("row_id", "p", "q", "chan", "i", "j", r("re").alias("re"), r("im").alias("im"), r("w", 2).alias("w"))


def cal_x3_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind of one's own: a phase that grows with frequency and time."""
    gains.register_kind("Dispersion", True, "", lambda value, t, nu, t_ref, nu_ref: value * (nu / 1e9) + value * t / 1e8)
    own = spark.range(1, 9).select(F.lit("Dispersion").alias("kind"), F.col("id").cast("int").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i")).select("kind", "p", "i", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("tcell")).select("kind", "p", "i", "tcell", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("fcell"), (F.col("p") * 0.05).alias("value"))
    c = calibrate(cells(spark, sf_dir), Solution(own, solution(spark).tcells, solution(spark).fcells), ["Dispersion"])
    return c.select("row_id", "p", "q", "chan", "i", "j", r("re").alias("re"), r("im").alias("im"))


def part_g12_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every integration of the dataset table is a cell."""
    rows = table(spark, sf_dir, "dataset").select(F.col("scan"), F.unix_micros(F.col("datetime").cast("timestamp")).cast("double").alias("t"))
    return time_mode(rows, "integration").cells.select("cell", "lo", "ref")


def part_x9_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition strategies of one's own on both axes."""
    v = vis(spark, sf_dir)
    frequency = frequency_mode(v.select("chan", "nu", "if_id").distinct(), lambda c: SimpleNamespace(cells=c.groupBy((F.col("chan") % 2 + 1).alias("cell")).agg(F.min("nu").alias("lo"), F.max("nu").alias("hi"))))
    time = time_mode(v.select("scan", "t").distinct(), lambda x: whole(x.where("scan % 2 = 0")))
    return frequency.cells.select(F.lit("frequency").alias("axis"), "cell", "lo", "hi").unionByName(time.cells.select(F.lit("time").alias("axis"), "cell", "lo", "hi"))


def part_x10_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans by a list of their starts."""
    return listed_scans([3e7, 9e7, 1.5e8])(vis(spark, sf_dir).select("t", "source").distinct()).groupBy("scan").agg(F.count("*").alias("n"), F.min("t").alias("t0"))


def part_g11_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = by_scan(vis(spark, sf_dir).select("scan", "t").distinct())
    return p.supports().join(p.references(), "cell").withColumn("n_cells", F.lit(p.n_cells()))


# --- residual tables ---------------------------------------------------------------------------------------------------


def win_w8_excursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run around every session's largest residual."""
    return excursion(table(spark, sf_dir, "observables"), ["session"], "obs_id", "tau_residual")


def agg_a21_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observables against the same with a shift that the model shares."""
    o = table(spark, sf_dir, "observables").select("obs_id", F.col("tau_total").alias("tau_correlator"), F.col("tau_ionosphere").alias("tau_model"), F.col("tau_residual").alias("tau_clock"))
    b = o.withColumn("tau_correlator", F.col("tau_correlator") + F.col("obs_id") % 7 * 1e-9).withColumn("tau_model", F.col("tau_model") + F.col("obs_id") % 7 * 1e-9)
    e = epoch_consistency(o, b)
    return e.select(r(F.col("median") * 1e9, 5).alias("median_ns"), r(F.col("sigma") * 1e9, 5).alias("sigma_ns"), "n", r(F.col("consistent_max") * 1e12, 1).alias("consistent_ps"), r(F.col("correlator_max") * 1e9, 3).alias("correlator_ns"), "n_rows")


def agg_a30_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median size of residuals of slots, pooled too, where a second column is small."""
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")))
    f = ast.displacement_floor(o.select(F.col("receptor_slot").alias("model_set"), F.abs(F.col("tau_residual") * 1e12).alias("shift"), (F.col("el1") - 0.5).alias("structure")), 0.2)
    return f.select("model_set", r("floor", 6).alias("floor"), "n")


def diag_d16_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = identifiability(table(spark, sf_dir, "dataset").select("session", "t", "source"), 600.0)
    v = identifiability_verdicts(census, "global")
    return v.select("level", "gate", F.col("subject").alias("session"), F.col("measured")["n_min"].alias("n_min"), F.col("measured")["n_stubs"].alias("n_stubs"))


# --- model terms -------------------------------------------------------------------------------------------------------


def fn_f18_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure delay of a single offset component: that of its offset."""
    o = table(spark, sf_dir, "observables").select("obs_id", F.col("a1").alias("source"), (F.cos("t") * 0.02).alias("dtau_dra"), (F.sin("t") * 0.02).alias("dtau_ddec"))
    names = table(spark, sf_dir, "antennas").where("name IS NOT NULL").groupBy(F.col("name").alias("source")).agg(F.min("antenna_no").alias("n"))
    models = names.where("n % 5 <> 0").select("source", F.array(F.struct(F.lit(2.0).alias("flux"), (F.col("n") * 0.1).alias("x"), (F.col("n") * -0.05).alias("y"))).alias("components"))
    chan = F.explode(F.array(*[F.struct(F.lit(c).alias("chan"), F.lit(NU0 + c * DNU).alias("nu")) for c in CHANNELS])).alias("c")
    rows = o.select("*", chan).select(F.col("obs_id").alias("row_key"), "source", "c.chan", "c.nu", F.lit(1.0).alias("w"), "dtau_dra", "dtau_ddec")
    return ast.structure_delays(rows, models).select("row_key", r(F.col("tau_structure") * 1e12, 3).alias("tau_ps"))


def fn_f20_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay that calibration took out, from its phases over the channels."""
    v = _points(spark, sf_dir).where("t = 0")
    rows = v.select((F.col("tcell") * 100 + F.col("p") * 10 + F.col("q")).alias("row_key"), "p", "q", F.lit(1).alias("slot"), "tcell", "chan", "nu", (F.col("chan") * 1.0).alias("w"))
    applied = _numbers(spark, sf_dir).select(F.col("k").alias("tcell"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("p"))
    applied = applied.select("p", F.lit(1).alias("slot"), "tcell", F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("chan")).withColumn("phase", 2 * math.pi * (F.col("tcell") % 7 + F.col("p")) * 1e-9 * (F.col("chan") - 1) * DNU + F.col("p"))
    return ast.applied_phase_delay(rows, applied).select("row_key", r(F.col("tau_applied") * 1e9, 4).alias("tau_ns"))


def fn_f9_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every source's delay at a station: below the Earth's radius over c, negative when the source is up, and
    partials that agree with differences (bending by the Sun, which partials leave out, is off)."""
    station = dm.Station(np.array([4075539.9, 931735.3, 4801629.4]), axis_offset=1.5)
    eop = {"ut1_utc": 0.1, "xp": 0.1, "yp": 0.3, "dx": 0.0, "dy": 0.0}

    def run(batches):
        for b in batches:
            ra, dec, frac = np.radians(b["ra_deg"].to_numpy()), np.radians(b["dec_deg"].to_numpy()), (b["source_rawid"].to_numpy() % 97) / 97.0
            of = lambda a, d: dm.geometric_delay(station, a, d, 60000.0, frac, eop, dm.Terms(gravitation=False))
            d, h = of(ra, dec), 1e-6
            by_ra = (of(ra + h / np.cos(dec), dec)["tau_without_axis"] - of(ra - h / np.cos(dec), dec)["tau_without_axis"]) / (2 * h)
            by_dec = (of(ra, dec + h)["tau_without_axis"] - of(ra, dec - h)["tau_without_axis"]) / (2 * h)
            close = lambda x, y: np.abs(x - y) < 1e-7
            yield pd.DataFrame({"source_rawid": b["source_rawid"], "bounded": np.abs(d["tau"]) < 0.0213, "signed": (np.sign(d["tau"]) == -np.sign(np.sin(d["el"]))) | (np.abs(d["el"]) < 0.01), "partials": close(d["dtau_dra"], by_ra) & close(d["dtau_ddec"], by_dec), "horizon": (np.abs(d["az"]) <= np.pi) & (np.abs(d["el"]) <= np.pi / 2)})

    s = table(spark, sf_dir, "sources").where("abs(dec_deg) < 89").select("source_rawid", "ra_deg", "dec_deg").distinct()
    return s.mapInPandas(run, "source_rawid int, bounded boolean, signed boolean, partials boolean, horizon boolean")


def fn_f21_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every source at two stations: hydrostatic delays of the size of an atmosphere, mappings above one, ionospheres in
    the ratio of their maps, partials below the light time of the Earth's radius (F7, F8, F10-F15, F21)."""
    t = np.arange(59990.0, 60011.0)
    eop = pd.DataFrame({"mjd": t, "ut1_utc": 0.1, "xp": 0.1, "yp": 0.3, "dx": 0.0, "dy": 0.0})
    flat = lambda x: dm.TecMaps(np.array([59999.0, 60002.0]), np.arange(-90, 91, 10.0), np.arange(-180, 181, 10.0), np.full((2, 19, 37), x), np.full((2, 19, 37), 2.0))
    loading = np.zeros((3, 11))
    loading[0, 0] = 0.01
    stations = {"A": dm.Station(np.array([4075539.9, 931735.3, 4801629.4]), 0.0, loading), "B": dm.Station(np.array([-1324009.0, -5332181.0, 3231962.0]), 2.0)}
    context = ast.ModelContext(stations, 60000.0, 56.0, 8.4e9, eop, {}, {"x": flat(20.0), "y": flat(24.0)}, "x")
    s = table(spark, sf_dir, "sources").select("source_rawid", F.radians("ra_deg").alias("ra"), F.radians("dec_deg").alias("dec")).distinct()
    keys = s.select((F.col("source_rawid") * 100.0).alias("t"), F.col("source_rawid").cast("string").alias("source"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("antenna"), "ra", "dec")
    x = ast.antenna_terms(keys, context)
    low, wet = F.col("el") <= 0.1, F.col("tau_model") - F.col("tau_geometric")
    return x.select(
        F.col("source").cast("int").alias("source_rawid"), "antenna", (low | wet.between(6e-9, 9e-8)).alias("hydrostatic"), (low | (F.col("wet") >= 1)).alias("mapped"), (F.abs(F.col("iono")[1] / F.col("iono")[0] - 1.2) < 1e-9).alias("ratio"),
        (F.hypot("dtau_dra", "dtau_ddec") < 0.0213).alias("bounded"), (F.abs(F.col("tau_geometric")) < 0.0213).alias("geometric"),
    )


def join_j6_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-day interpolation of Earth orientation is exact on a cubic."""
    t = np.arange(59990.0, 60011.0)
    cubic = lambda x: 0.1 + 0.01 * (x - 60000) - 0.002 * (x - 60000) ** 2 + 1e-4 * (x - 60000) ** 3
    context = ast.ModelContext({}, 60000.0, 56.0, 8.4e9, pd.DataFrame({"mjd": t, "ut1_utc": cubic(t), "xp": cubic(t) * 2, "yp": -cubic(t), "dx": t - 60000, "dy": 60000 - t}), {}, {}, "")

    def run(batches):
        for b in batches:
            got = context.orientation(59995 + (b["source_rawid"].to_numpy() % 101) / 10)
            yield b.assign(ut1_utc=got["ut1_utc"], xp=got["xp"], dx=got["dx"])

    s = table(spark, sf_dir, "sources").select("source_rawid").distinct()
    return s.mapInPandas(run, "source_rawid int, ut1_utc double, xp double, dx double").select("source_rawid", r("ut1_utc", 8).alias("ut1_utc"), r("xp", 8).alias("xp"), r("dx", 6).alias("dx"))


def est_n10_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all observables from terms per (t, source, antenna) made by formulas."""
    o = table(spark, sf_dir, "observables").where("source IS NOT NULL").select("obs_id", "scan", "source", "a1", "a2", F.col("receptor_slot").alias("slot"), "t", "delay", "rate", "snr", F.col("sigma_tau").alias("sigma_delay"), F.lit(1.0).alias("weight"))
    keys = o.select("t", "source", F.explode(F.array("a1", "a2")).alias("antenna")).distinct()
    n = F.length("antenna") + F.ascii("antenna") % 7
    zero = lambda *c: [F.lit(0.0).alias(x) for x in c]
    terms = keys.select("t", "source", "antenna", *zero("mjd", "tau_geometric"), (n * 1e-9 + F.col("t") * 1e-13).alias("tau_model"), *zero("el", "az", "wet", "grad", "dtau_dra", "dtau_ddec"), F.array(n * 1e-11, n * 3e-11).alias("iono"))
    correlator = keys.select("t", "source", "antenna", (n * 2e-9).alias("tau_correlator"), (n * 1e-10).alias("tau_clock"))
    one = o.select(F.col("obs_id").alias("row_key"), (F.col("obs_id") % 5 * 1e-10).alias("tau_applied"), (F.col("obs_id") % 3 * 1e-10).alias("tau_structure")).where("row_key % 2 = 0")
    x = ast.total_delays(o, terms, correlator, one.select("row_key", "tau_applied"), one.select("row_key", "tau_structure"), SimpleNamespace(tec={"a": None, "b": None}, primary="a", inflation=1.5))
    return x.select("obs_id", r(F.col("tau_total") * 1e12, 1).alias("total_ps"), r(F.col("tau_iono") * 1e12, 1).alias("iono_ps"), r(F.col("sigma_iono") * 1e12, 1).alias("sigma_iono_ps"), r(F.col("tau_residual") * 1e12, 1).alias("residual_ps"))


# --- catalogues --------------------------------------------------------------------------------------------------------


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").groupBy("source_rawid").agg(F.min("name").alias("source"), F.min("rfc_jname").alias("jname"), F.radians(F.min("ra_deg")).alias("ra"), F.radians(F.min("dec_deg")).alias("dec"))


def join_j13_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published table for two model sets over all sources."""
    s = _reference(spark, sf_dir)
    k = F.col("source_rawid")
    p = s.select("source", "source_rawid", F.explode(F.array(F.lit("point"), F.lit("own"))).alias("model_set")).select("source", "model_set", F.col("model_set").alias("kind"), (k % 9 - 4.0).alias("dra_mas"), (k % 5 - 2.0).alias("ddec_mas"), F.lit(0.1).alias("sigma_ra_mas"), F.lit(0.2).alias("sigma_dec_mas"))
    facts = s.where(k % 2 == 0).select("source", F.lit("own").alias("model_set"), (k * 0.5).alias("wrms_ps"), k.alias("n_accepted"), F.lit(1.5).alias("peak_x_mas"), F.lit(-0.5).alias("peak_y_mas"), F.concat("source", F.lit(".fits")).alias("image_file"))
    c = catalogue_rows(p, s, facts, {"s": 2.0, "floor_ra_mas": 0.3, "floor_dec_mas": 0.3})
    return c.select("source", "model_set", "jname", r("ra_reference_deg", 8).alias("ra_reference_deg"), r(F.radians("ra_deg") * 1e6, 4).alias("ra_urad"), r(F.radians("dec_deg") * 1e6, 4).alias("dec_urad"), r("sigma_ra_final_mas", 6).alias("sigma_ra"), r("sigma_dec_final_mas", 6).alias("sigma_dec"), F.when(~F.isnan("peak_dec_deg"), r(F.radians("peak_dec_deg") * 1e6, 4)).alias("peak_dec_urad"), F.when(~F.isnan("wrms_ps"), F.col("wrms_ps")).alias("wrms_ps"), "n_accepted", "n_selected", "image_file")


def join_j14_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of every name in the dataset table, which must be there once."""
    s = table(spark, sf_dir, "sessions").select("session", "grid_s", "n_antennas")
    return ast.strict_lookup(table(spark, sf_dir, "dataset").select("session"), s, "session")


def est_n15_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that differ from a catalogue by a rotation alone: it is found and nothing is left."""
    s = _reference(spark, sf_dir).select("source", "ra", "dec")
    a = (0.3, -0.2, 0.5)
    sa, ca, sd, cd = F.sin("ra"), F.cos("ra"), F.sin("dec"), F.cos("dec")
    p = s.withColumn("dra_mas", -sd * ca * a[0] - sd * sa * a[1] + cd * a[2]).withColumn("ddec_mas", sa * a[0] - ca * a[1])
    got = reference_agreement(p, s.select("source", F.lit(0.0).alias("ref_ra"), F.lit(0.0).alias("ref_dec")))
    rows = [("n", float(got["n"])), ("rms_ra", got["rms_ra"]), ("rms_dec", got["rms_dec"]), ("rotated_ra", got["rotated_ra"]), ("rotated_dec", got["rotated_dec"]), *[(f"a{k}", float(x)) for k, x in enumerate(got["rotation"])]]
    return spark.createDataFrame(rows, "what string, value double").select("what", r("value").alias("value"))


# --- what-if -----------------------------------------------------------------------------------------------------------


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed delays of every session's baselines and residuals with k % 3 - 1 of them left, and a linear clock."""
    v = _numbers(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("p")).select("k", "p", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("n"))
    x = F.sin(F.col("n") / 3 * F.col("p"))
    return v.select("k", "p", (F.col("n") * 10.0).alias("t"), x.alias("installed"), (x * (F.col("k") % 3 - 1) + 2 + F.col("n") * 0.01 * F.col("p")).alias("residual"), (x * (F.col("k") % 3 - 1)).alias("left"))


def diag_d8_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = whatif.sign_regressions(_signed(spark, sf_dir), ["k", "p"], 600.0)
    return s.select("k", "p", r("slope", 6).alias("slope"), "n")


def diag_d9_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signed(spark, sf_dir).select("k", F.col("left").alias("residual"), "installed", F.lit(1.0).alias("w"), "p")
    scan = whatif.fraction_scan(rows, ["k"], [-1.5, -0.75, 0.0, 0.75, 1.5], {"all": F.lit(True), "some": F.col("p") > 3})
    return whatif.scan_minima(scan, ["arm", "k"]).select("arm", "k", r("scale", 6).alias("scale"), r("value", 3).alias("value"))


def diag_d9_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the calibration applied, left out and turned."""
    a = instrumental_arms(_corrupted(spark, sf_dir), _truth(spark, sf_dir), (1.0, 0.0), DNU, SEARCH, 3.0)
    return a.select("arm", "n", "detection")


def diag_d7_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injections for every observable: rows per family and repetition, and whether their size is as asked for."""
    o = table(spark, sf_dir, "observables").where(F.col("t").isNotNull()).select("obs_id", "a1", "a2", "t", (1 / F.sin("el1")).alias("wet1"), (1 / F.sin("el2")).alias("wet2"), F.col("tau_ionosphere").alias("tau_iono"))
    f = whatif.injection_families(o, reps=2, modes=20)
    g = f.groupBy("family", "label").agg(F.count("*").alias("n"), F.max(F.abs("injected")).alias("most"))
    return g.select("family", "label", "n", ((F.col("family") == "iono_scale") | (F.col("family") == "zwd_turbulence") | (F.col("most") <= 30.0001e-12)).alias("bounded"))


def diag_d7_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources lose in the halves by slot."""
    o = table(spark, sf_dir, "observables").select("source", "scan", "t", "el1", "el2", F.col("receptor_slot").alias("slot"))
    g = whatif.split_geometry(o, "slot = 1")
    return g.select("source", "half", "n_obs", "n_scans", r("t_span_h", 6).alias("t_span_h"), r("el_span_deg", 6).alias("el_span_deg"))


def diag_d1_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solves of one session under changes: with noise-free data settings, halves and left-out antennas change nothing, an
    injected offset comes back whole, and a model set's structure moves positions by its offset (D1, D3-D7, A23, A33, N11)."""
    first = table(spark, sf_dir, "sessions").agg(F.min("session")).first()[0]
    o = stored(_delays(spark, sf_dir).where(F.col("session") == first).withColumn("scan", F.col("n").cast("int")))
    spec = DelayFit("A1", reweight=False, reject=False, robust_iterations=0)
    base = whatif.fit(spec, o)
    most = lambda d: float(d[["dra_mas", "ddec_mas"]].abs().to_numpy().max())
    halves = whatif.split_solves(o, spec)
    shift = o.select("obs_id", (F.col("dtau_dra") * MAS).alias("injected"))
    moved = whatif.transfer(o, spec, {"shift": [shift], "none": [shift.where("false")]}).set_index("family")["mean_mas"]
    sets = whatif.register({"point": o, "moved": o.join(shift, "obs_id").withColumn("tau_residual", F.col("tau_residual") - F.col("injected")).drop("injected")}, spec)
    d = whatif.compare(sets["point"]["fit"], sets["moved"]["fit"])
    rows = [
        ("variant", most(whatif.compare(base, whatif.variant(o, spec, clock_node=1800.0)))), ("halves", max(most(x) for n, (_, _, x) in halves.items() if n == "slot") if "slot" in halves else 0.0),
        ("jackknife", max(most(x) for x in whatif.jackknife(o, spec).values())), ("constraints", whatif.constraint_chi2(base)), ("stress", float(whatif.stress(o, spec, {"min_snr": [10.0]})["rms_ra_mas"].max())),
        ("transfer", float(moved["shift"]) * math.sqrt(2)), ("no transfer", float(moved["none"])), ("registered ra", float(d["dra_mas"].mean())), ("registered dec", float(d["ddec_mas"].mean())), ("summary rows", float(len(whatif.fit_summary(sets)))),
        ("baselines", float(sets["point"]["baselines"].count())), ("sources", float(sets["point"]["sources"].count())),
    ]
    return spark.createDataFrame(rows, "what string, value double").select("what", r("value", 4).alias("value"))


# --- images and closures against models --------------------------------------------------------------------------------


def _two(k) -> list:
    """Two components of every session: a core and a jet whose side depends on the number."""
    side = F.when(k % 2 == 0, 6.0).otherwise(-6.0)
    return [F.struct(F.lit(1.0).alias("flux"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.5).alias("flux"), side.alias("x"), F.lit(4.0).alias("y"))]


def _modelled_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, p, q, t, chan, u, v, re, im, w) of the two components on 6 antennas, scaled by 1.5; source is the number."""
    v = _points(spark, sf_dir).select(F.col("tcell").alias("source"), "p", "q", "t", "chan")
    place = lambda f, a: f(F.col(a) * 2.4 + F.col("t") / 5) * (0.05 + 0.02 * F.col(a)) * (1 + F.col("chan") / 40)
    v = v.withColumn("u", place(F.cos, "p") - place(F.cos, "q")).withColumn("v", place(F.sin, "p") - place(F.sin, "q"))
    c = F.array(*_two(F.col("source")))
    arg = lambda x: 2 * math.pi * (F.col("u") * x["x"] + F.col("v") * x["y"])
    total = lambda f: 1.5 * F.aggregate(c, F.lit(0.0), lambda a, x: a + x["flux"] * f(arg(x)))
    return v.withColumn("re", total(F.cos)).withColumn("im", total(F.sin)).withColumn("w", F.lit(1e6)).withColumn("scan", F.lit(1)).withColumn("row_id", F.lit(1))


def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select(F.col("k").alias("source"), F.array(*_two(F.col("k"))).alias("components"))


def img_i10_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps outside the core match their own model, and its image in the mirror less."""
    from vislake.functions.imagemath import Grid

    images = stored(image_sources(_modelled_uv(spark, sf_dir).select("source", "u", "v", "re", "im", "w"), Grid(64, 0.5), 0.1, 20_000, 3.0, 1.0))
    c = beam_matched_correlation(images, _two_models(spark, sf_dir))
    return c.select("source", (F.col("r") > 0.9).alias("matches"), (F.col("r_rotated") < F.col("r") - 0.2).alias("mirrored_less"))


def img_i10_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes against the model, by antenna and pooled over bins: 1.5 everywhere."""
    bins, antennas = amplitude_ratios(_modelled_uv(spark, sf_dir), _two_models(spark, sf_dir), 1.0, 3.0, 0.0, 1)
    per = bins.groupBy("source").agg(F.sum("n").alias("n"), r(F.avg("ratio"), 6).alias("ratio")).select("source", F.lit(0).alias("antenna"), "n", "ratio")
    return antennas.select("source", "antenna", "n", r("ratio", 6).alias("ratio")).unionByName(per)


def agg_a14_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures of every session against its own model: nothing is left of phases or amplitudes."""
    sets = _two_models(spark, sf_dir).select(F.lit("own").alias("model_set"), "source", "components")
    c = closure_evaluation(_modelled_uv(spark, sf_dir), sets, 1.0, 3.0)
    return c.select("model_set", "source", r("chi2_phase", 6).alias("chi2_phase"), "n_phase", r("chi2_amp", 6).alias("chi2_amp"), r("rms_amp", 6).alias("rms_amp"), "n_amp")


QUERIES = {f.__name__: f for f in (
    agg_a3_grid, agg_a6_traces, agg_a7_timelines, ui_u8_displayed, ui_u7_cadence, ui_u7_slots, join_j15_uv_snr, sel_x1_callable, sel_p19_scaled, cal_x3_kind, part_g12_integration, part_x9_strategy, part_x10_scans, part_g11_accessors,
    win_w8_excursion, agg_a21_epoch, agg_a30_floor, diag_d16_ensembles, fn_f18_structure, fn_f20_applied, fn_f9_delay, fn_f21_terms, join_j6_cubic, est_n10_totals, join_j13_catalogue, join_j14_lookup, est_n15_agreement, diag_d8_sign, diag_d9_scan, diag_d9_arms,
    diag_d7_families, diag_d7_geometry, diag_d1_whatif, img_i10_correlation, img_i10_ratios, agg_a14_closures,
)}

_ROT = lambda f, t: f"re * cos({f}) {'+' if t else '-'} im * sin({f})"
_OBS_N = "(length({0}) + ascii({0}) % 7)"
_GRID = len(TIMES) * len(CHANNELS)

ORACLE = {
    "agg_a3_grid": with_vis("SELECT p, q, chan, i, j, round(sr / sqrt(sr * sr + si * si), 5) + 0 AS cos_phase, round(si / sqrt(sr * sr + si * si), 5) + 0 AS sin_phase, round(sqrt(sr * sr + si * si) / w, 5) AS amp, round(w, 2) AS w FROM (SELECT p, q, chan, i, j, sum(w * re) sr, sum(w * im) si, sum(w) w FROM vis WHERE w > 0 GROUP BY ALL)"),
    "agg_a6_traces": with_vis("SELECT p, i, fcell, CAST(row_number() OVER (PARTITION BY p, i, fcell ORDER BY tcell) - 1 AS INT) AS place, tcell, p - 4 + 0e0 AS delay_ns FROM (SELECT p, i, fcell, tcell FROM cells WHERE w > 0 AND tcell BETWEEN 1 AND 7 UNION SELECT q, j, fcell, tcell FROM cells WHERE w > 0 AND tcell BETWEEN 1 AND 7)", CELLS_CTE),
    "agg_a7_timelines": "WITH c AS (SELECT DISTINCT a1 name, CAST(substr(session, 3) AS DOUBLE) lo FROM observables), l AS (SELECT name, list(lo ORDER BY lo) x FROM c GROUP BY name) SELECT min(name) AS first_name, CAST(count(*) AS INT) AS n_names, len(x) AS n_cells, x[1] AS first_lo FROM l GROUP BY x",
    "ui_u8_displayed": "SELECT CAST(p AS INT) AS p, CAST(i AS INT) AS i, CAST(t AS INT) AS tcell, CAST(f AS INT) AS fcell, p - 4 + 0e0 AS value, 'ns' AS unit FROM range(1, 9) a(p), range(1, 3) b(i), range(1, 8) c(t), range(1, 3) d(f)",
    "ui_u7_cadence": "WITH d AS (SELECT DISTINCT session || ':' || scan s, t FROM dataset), e AS (SELECT s, t - lag(t) OVER (PARTITION BY s ORDER BY t) d FROM d) SELECT s AS scan, round(median(d) FILTER (d > 0), 6) AS step, count(*) AS n FROM e GROUP BY s",
    "ui_u7_slots": with_vis("SELECT p, i FROM vis WHERE w > 0 UNION SELECT q, j FROM vis WHERE w > 0"),
    "sel_x1_callable": with_vis("SELECT row_id, p, q, source, chan, i, j, round(re, 8) + 0 AS re FROM vis WHERE source % 2 = 0 AND t > 5e7 AND chan IN (1, 3, 6)"),
    "sel_p19_scaled": with_vis(f"SELECT row_id, p, q, chan, i, j, round({_ROT('f', True)}, 6) + 0 AS re, round(im * cos(f) - re * sin(f), 6) + 0 AS im, round(CASE WHEN w > 0 THEN w ELSE 0 END, 2) + 0 AS w FROM (SELECT *, 6.283185307179586e0 * 0.5e-9 * (p - q) * (nu - CASE WHEN fcell = 1 THEN {NU0 + 1.5 * DNU}::DOUBLE ELSE {NU0 + 5 * DNU + 1e8}::DOUBLE END) f FROM cells)", CELLS_CTE),
    "cal_x3_kind": with_vis(f"SELECT row_id, p, q, chan, i, j, round({_ROT('f', True)}, 6) + 0 AS re, round(im * cos(f) - re * sin(f), 6) + 0 AS im FROM (SELECT *, 0.05e0 * (p - q) * (nu / 1e9 + t / 1e8) f FROM cells)", CELLS_CTE),
    "part_g12_integration": "SELECT CAST(row_number() OVER (ORDER BY t) AS INT) AS cell, t AS lo, t AS ref FROM (SELECT DISTINCT CAST(epoch_us(datetime) AS DOUBLE) t FROM dataset WHERE datetime IS NOT NULL)",
    "part_x9_strategy": with_vis("SELECT 'frequency' AS axis, CAST(chan % 2 + 1 AS INT) AS cell, min(nu) AS lo, max(nu) AS hi FROM vis GROUP BY ALL UNION ALL SELECT 'time', 1, min(t), max(t) FROM vis WHERE scan % 2 = 0"),
    "part_x10_scans": with_vis("SELECT CAST((t >= 3e7)::INT + (t >= 9e7)::INT + (t >= 1.5e8)::INT AS INT) AS scan, count(*) AS n, min(t) AS t0 FROM (SELECT DISTINCT t, source FROM vis) GROUP BY ALL"),
    "part_g11_accessors": with_vis("SELECT CAST(row_number() OVER (ORDER BY scan) AS INT) AS cell, min(t) AS lo, max(t) AS hi, (min(t) + max(t)) / 2 AS ref, CAST(count(*) OVER () AS INT) AS n_cells FROM vis GROUP BY scan"),
    "win_w8_excursion": """
WITH o AS (SELECT session, obs_id, abs(tau_residual) a FROM observables WHERE tau_residual IS NOT NULL AND CAST(tau_residual AS VARCHAR) <> 'nan'),
p AS (SELECT session, max(a) m FROM o GROUP BY session), k AS (SELECT o.session, m, min(obs_id) peak FROM o JOIN p USING (session) WHERE a = m GROUP BY ALL),
w AS (SELECT o.*, peak, a < m / 2 weak FROM o JOIN k USING (session)), s AS (SELECT session, peak, max(obs_id) FILTER (weak AND obs_id < peak) l, min(obs_id) FILTER (weak AND obs_id > peak) h FROM w GROUP BY ALL)
SELECT w.session, w.peak, min(obs_id) FILTER (l IS NULL OR obs_id > l) AS low, max(obs_id) FILTER (h IS NULL OR obs_id < h) AS high FROM w JOIN s USING (session) GROUP BY ALL""",
    "agg_a21_epoch": """
WITH o AS (SELECT obs_id % 7 * 1e-9 s, tau_total c, tau_ionosphere m, tau_residual k FROM observables),
f AS (SELECT *, CASE WHEN isfinite(c) AND isfinite(m) AND isfinite(k) THEN c - m + k END x FROM o), md AS (SELECT median(x) md FROM f)
SELECT round(any_value(md) * 1e9, 5) + 0 AS median_ns, round(1.4826e0 * median(abs(x - md)) * 1e9, 5) + 0 AS sigma_ns, count(x) AS n, 0e0 AS consistent_ps, round(max(s) FILTER (isfinite(c)) * 1e9, 3) + 0 AS correlator_ns, count(*) AS n_rows FROM f, md""",
    "agg_a30_floor": "SELECT receptor_slot AS model_set, round(median(abs(tau_residual * 1e12)), 6) + 0 AS floor, count(*) AS n FROM observables WHERE isfinite(tau_residual) AND abs(el1 - 0.5) < 0.2 GROUP BY ROLLUP (receptor_slot)",
    "diag_d16_ensembles": """
WITH b AS (SELECT session, t, source, min(t) OVER w t0, max(t) OVER w t1 FROM dataset WINDOW w AS (PARTITION BY session)),
c AS (SELECT session, least(floor((t - t0) / 600) + 1, greatest(ceil((t1 - t0) / 600), 1)) cell, source, t FROM b), g AS (SELECT session, cell, count(DISTINCT source) k, max(t) - min(t) span FROM c GROUP BY ALL),
m AS (SELECT session, min(k) FILTER (span >= 300) n, count(*) FILTER (span < 300) s FROM g GROUP BY session)
SELECT CASE WHEN n IS NULL OR n < 4 THEN 'warn' ELSE 'pass' END AS level, 'amp-identifiability' AS gate, session, n + 0e0 AS n_min, s + 0e0 AS n_stubs FROM m""",
    "fn_f18_structure": f"WITH n AS (SELECT name, min(antenna_no) n FROM antennas WHERE name IS NOT NULL GROUP BY name) SELECT obs_id AS row_key, round(CASE WHEN n % 5 <> 0 THEN (n * 0.1e0 * cos(t) * 0.02e0 - n * 0.05e0 * sin(t) * 0.02e0) * {MAS!r}::DOUBLE * 1e12 ELSE 0 END, 3) + 0 AS tau_ps FROM observables LEFT JOIN n ON a1 = name",
    "fn_f20_applied": f"WITH {_K}, {_PQ} SELECT k * 100 + p * 10 + q AS row_key, q - p + 0e0 AS tau_ns FROM k, b",
    "fn_f9_delay": "SELECT DISTINCT source_rawid, true AS bounded, true AS signed, true AS partials, true AS horizon FROM (SELECT DISTINCT source_rawid, ra_deg, dec_deg FROM sources WHERE abs(dec_deg) < 89)",
    "fn_f21_terms": "SELECT source_rawid, a AS antenna, true AS hydrostatic, true AS mapped, true AS ratio, true AS bounded, true AS geometric FROM (SELECT DISTINCT source_rawid, ra_deg, dec_deg FROM sources), (VALUES ('A'), ('B')) v(a)",
    "join_j6_cubic": "WITH x AS (SELECT DISTINCT source_rawid, -5 + (source_rawid % 101) / 10e0 x FROM sources), c AS (SELECT *, 0.1e0 + 0.01e0 * x - 0.002e0 * x * x + 1e-4 * x * x * x c FROM x) SELECT source_rawid, round(c, 8) + 0 AS ut1_utc, round(2 * c, 8) + 0 AS xp, round(x, 6) + 0 AS dx FROM c",
    "est_n10_totals": f"""
WITH o AS (SELECT obs_id, delay, {_OBS_N.format('a2')} - {_OBS_N.format('a1')} n, CASE WHEN obs_id % 2 = 0 THEN obs_id % 5 * 1e-10 ELSE 0 END ap, CASE WHEN obs_id % 2 = 0 THEN obs_id % 3 * 1e-10 ELSE 0 END st FROM observables WHERE source IS NOT NULL AND t IS NOT NULL),
x AS (SELECT *, n * 2e-9 + ap - delay tot FROM o)
SELECT obs_id, round(tot * 1e12, 1) + 0 AS total_ps, round(n * 10e0, 1) + 0 AS iono_ps, round(abs(n) * 20e0 / sqrt(2) * 1.5e0, 1) + 0 AS sigma_iono_ps, round((tot - n * 1e-11 - st - n * 1e-9 + n * 1e-10) * 1e12, 1) + 0 AS residual_ps FROM x""",
    "join_j13_catalogue": f"""
WITH s AS (SELECT source_rawid k, min(name) source, min(rfc_jname) jname, radians(min(ra_deg)) ra, radians(min(dec_deg)) de FROM sources GROUP BY source_rawid),
m AS (SELECT *, unnest(['point', 'own']) model_set FROM s), x AS (SELECT *, model_set = 'own' AND k % 2 = 0 h, ra + (k % 9 - 4) * {MAS!r}::DOUBLE / cos(de) fr, de + (k % 5 - 2) * {MAS!r}::DOUBLE fd FROM m)
SELECT source, model_set, coalesce(jname, '') AS jname, round(degrees(ra), 8) + 0 AS ra_reference_deg, round(fr * 1e6, 4) + 0 AS ra_urad, round(fd * 1e6, 4) + 0 AS dec_urad, round(sqrt(0.04e0 + 0.09e0), 6) AS sigma_ra, round(sqrt(0.16e0 + 0.09e0), 6) AS sigma_dec,
  CASE WHEN h THEN round((fd - 0.5e0 * {MAS!r}::DOUBLE) * 1e6, 4) + 0 END AS peak_dec_urad, CASE WHEN h THEN k * 0.5e0 END AS wrms_ps, CASE WHEN h THEN k ELSE 0 END AS n_accepted, 0 AS n_selected, CASE WHEN h THEN source || '.fits' ELSE '' END AS image_file FROM x""",
    "join_j15_uv_snr": with_vis(f"SELECT avg_.source, avg_.p, avg_.q, tcell, fcell, i, j, round(w, 2) + 0 AS snr, round(sqrt(u * u + v * v) * {NU0}::DOUBLE / 299792458e0, 1) + 0 AS uv_wavelengths FROM avg_ JOIN arows USING (source, p, q, tcell)", CELLS_CTE, _AVG.format(src="cells"), _ROWS),
    "join_j14_lookup": "SELECT DISTINCT session, grid_s, n_antennas FROM sessions WHERE session IN (SELECT session FROM dataset)",
    "est_n15_agreement": """
WITH s AS (SELECT source_rawid, radians(min(ra_deg)) a, radians(min(dec_deg)) d FROM sources GROUP BY source_rawid),
o AS (SELECT -sin(d) * cos(a) * 0.3e0 + sin(d) * sin(a) * 0.2e0 + cos(d) * 0.5e0 x, sin(a) * 0.3e0 + cos(a) * 0.2e0 y FROM s)
SELECT 'n' AS what, count(*) + 0e0 AS value FROM o UNION ALL SELECT 'rms_ra', round(sqrt(avg(x * x)), 6) FROM o UNION ALL SELECT 'rms_dec', round(sqrt(avg(y * y)), 6) FROM o
UNION ALL SELECT * FROM (VALUES ('rotated_ra', 0e0), ('rotated_dec', 0e0), ('a0', 0.3e0), ('a1', -0.2e0), ('a2', 0.5e0))""",
    "diag_d8_sign": f"WITH {_K} SELECT k, CAST(p AS INT) AS p, k % 3 - 1 + 0e0 AS slope, 60 AS n FROM k, range(2, 7) r(p)",
    "diag_d9_scan": f"WITH {_K} SELECT a AS arm, k, k % 3 - 1 + 0e0 AS scale, 0e0 AS value FROM k, (VALUES ('all'), ('some')) v(a)",
    "diag_d9_arms": f"WITH {_K}, {_PQ} SELECT arm + 0e0 AS arm, count(*) AS n, 1e0 AS detection FROM k, b, (VALUES (1), (0)) v(arm) GROUP BY arm",
    "diag_d7_families": "WITH l AS (SELECT * FROM (VALUES ('diurnal', 'diurnal#1'), ('diurnal', 'diurnal#2'), ('semidiurnal', 'semidiurnal#1'), ('semidiurnal', 'semidiurnal#2'), ('iono_scale', 'iono -20%'), ('iono_scale', 'iono +20%'), ('zwd_turbulence', 'wet#1'), ('zwd_turbulence', 'wet#2')) v(family, label)) SELECT family, label, (SELECT count(*) FROM observables WHERE t IS NOT NULL) AS n, true AS bounded FROM l",
    "diag_d7_geometry": """
WITH g AS (SELECT source, CASE WHEN receptor_slot = 1 THEN 'a' ELSE 'b' END half, count(*) n_obs, count(DISTINCT scan) n_scans, (max(t) - min(t)) / 3600 t_span_h, degrees(max(greatest(el1, el2)) - min(least(el1, el2))) el_span_deg FROM observables GROUP BY ALL),
a AS (SELECT * FROM g UNION ALL SELECT source, NULL, min(n_obs), min(n_scans), min(t_span_h), min(el_span_deg) FROM g GROUP BY source HAVING count(*) = 2)
SELECT source, half, n_obs, n_scans, round(t_span_h, 6) + 0 AS t_span_h, round(el_span_deg, 6) + 0 AS el_span_deg FROM a""",
    "diag_d1_whatif": "SELECT * FROM (VALUES ('variant', 0e0), ('halves', 0e0), ('jackknife', 0e0), ('constraints', 0e0), ('stress', 0e0), ('transfer', 1e0), ('no transfer', 0e0), ('registered ra', 1e0), ('registered dec', 0e0), ('summary rows', 2e0), ('baselines', 10e0), ('sources', 6e0)) v(what, value)",
    "img_i10_correlation": f"WITH {_K} SELECT k AS source, true AS matches, true AS mirrored_less FROM k",
    "img_i10_ratios": f"WITH {_K} SELECT k AS source, CAST(a AS INT) AS antenna, CASE WHEN a = 0 THEN 15 ELSE 5 END * {_GRID} AS n, 1.5e0 AS ratio FROM k, range(0, 7) r(a)",
    "agg_a14_closures": f"WITH {_K} SELECT 'own' AS model_set, k AS source, 0e0 AS chi2_phase, 20 * {_GRID} AS n_phase, 0e0 AS chi2_amp, 0e0 AS rms_amp, 45 * {_GRID} AS n_amp FROM k",
}
