"""Delay models, sources, sinks, astrometry chain, schedule, streams."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.functions import columns as fc
from vislake.functions import delaymodel as dm
from vislake.functions.fringemath import Search
from vislake.operators import astrometry as ast
from vislake.operators.combine import band_plan, combine, merged_dimension, near_duplicates
from vislake.operators.gains import Solution, calibrate
from vislake.plans import inspect as ui
from vislake.plans.config import ExternalModels, OwnImaging, SessionConfig
from vislake.plans.schedule import Capture, alignment_step, bandpass_step, fringe_step, measure_step, run
from vislake.sources import fits, readers, sinks
from vislake.streaming import twins
from test_kernels import _vis

EOP = {"ut1_utc": 0.1, "xp": 0.1, "yp": 0.3, "dx": 0.0, "dy": 0.0}
XYZ = np.array([4075539.9, 931735.3, 4801629.4])


def test_leap_seconds_and_split_epochs():
    assert dm.tai_minus_utc(np.array([41317.0, 57753.9, 57754.0, 60000.0])).tolist() == [10, 36, 37, 37]
    day, frac = dm.split_mjd(60000.25, np.array([0.0, 86400.0]))
    assert day.tolist() == [60000, 60001] and np.allclose(frac, 0.25)


def test_geodetic_round_trip():
    lon, lat, h = dm.geodetic(XYZ)
    e2 = dm.FLATTENING * (2 - dm.FLATTENING)
    n = dm.EARTH_RADIUS / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    back = np.array([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + h) * np.sin(lat)])
    assert np.allclose(back, XYZ, atol=1e-5)


def test_rotation_is_orthogonal_and_turns_once_a_sidereal_day():
    m = dm.celestial_to_terrestrial([60000.0, 60000.0], [0.0, 0.99726957], 0.1, 0.1, 0.3, 0.0, 0.0)
    assert np.allclose(m[0] @ m[0].T, np.eye(3), atol=1e-12) and np.linalg.det(m[0]) == pytest.approx(1)
    assert np.allclose(m[0], m[1], atol=2e-6)


def test_sun_and_moon_are_where_they_belong():
    sun, moon = dm.sun_position(np.array([51544.5])), dm.moon_position(np.array([51544.5]))
    assert np.linalg.norm(sun) / dm.AU == pytest.approx(0.983, abs=1e-3)
    assert math.degrees(math.atan2(sun[0, 1], sun[0, 0])) % 360 == pytest.approx(281.3, abs=0.1)
    assert 3.5e8 < np.linalg.norm(moon) < 4.1e8 and np.linalg.norm(dm.earth_velocity(np.array([60000.0]))) == pytest.approx(29_800, rel=0.03)


def test_pole_and_tides_against_published_values():
    """The test cases that the public IAU and IERS routines come with."""
    x, y = dm.pole(np.array([(53736.0 - 51544.5) / 36525]))
    assert abs(x[0] - 0.5791308482835293e-3) < 6 * dm.MAS and abs(y[0] - 0.4020580099454020e-4) < 6 * dm.MAS
    full = dm.pole(np.array([0.1]), dm.NUTATION)[0] - dm.pole(np.array([0.1]))[0]
    assert 0 < abs(full[0]) < 5 * dm.MAS  # the same terms without their out-of-phase parts
    xyz, sun, moon = (np.array([a]) for a in ([4075578.385, 931852.890, 4801570.154], [137859926952.015, 54228127881.4350, 23509422341.6960], [-179996231.920342, -312468450.131567, -169288918.592160]))
    d = dm.solid_tide(xyz, sun, dm.GM_SUN) + dm.solid_tide(xyz, moon, dm.GM_MOON) + dm.solid_tide_bands(xyz, np.array([54934.0]))
    assert np.allclose(d[0], [0.07700420357, 0.06304056322, 0.05516568153], atol=1e-4)


def test_planets_are_where_they_belong():
    p = {n: dm.planet_position(n, np.array([51544.5, 60000.0])) / dm.AU for n in dm.PLANETS}
    assert np.allclose(np.linalg.norm(p["jupiter"], axis=1), [4.965, 4.95], atol=0.03) and np.allclose(p["venus"][0], [-0.7183, -0.0463, 0.0246], atol=1e-3)
    assert all(dm.PLANETS[n][1][0] * 0.75 < np.linalg.norm(x, axis=1).min() for n, x in p.items())


def test_geometric_delay_partials_and_signs():
    st, args = dm.Station(XYZ, axis_offset=1.5), (60000.0, 0.3)
    d = dm.geometric_delay(st, 1.0, 0.5, *args, EOP)
    step = 1e-6
    ra = [dm.geometric_delay(st, 1.0 + s * step / np.cos(0.5), 0.5, *args, EOP)["tau_without_axis"][0] for s in (1, -1)]
    dec = [dm.geometric_delay(st, 1.0, 0.5 + s * step, *args, EOP)["tau_without_axis"][0] for s in (1, -1)]
    assert d["dtau_dra"][0] == pytest.approx((ra[0] - ra[1]) / (2 * step), rel=1e-5) and d["dtau_ddec"][0] == pytest.approx((dec[0] - dec[1]) / (2 * step), rel=1e-5)
    assert abs(d["tau"][0]) < 0.0213 and np.sign(d["tau"][0]) == -np.sign(np.sin(d["el"][0]))
    off = dm.Terms(*[False] * 6)
    plain = dm.geometric_delay(st, 1.0, 0.5, *args, EOP, off)["tau"][0]
    assert abs(plain - d["tau"][0]) < 5e-6  # aberration dominates
    tides = dm.geometric_delay(st, 1.0, 0.5, *args, EOP, dm.Terms(solid_tides=False))["tau"][0]
    assert 0 < abs(tides - d["tau"][0]) < 0.6 / dm.C_LIGHT


def test_small_displacements():
    lon, lat, _ = dm.geodetic(XYZ[None])
    assert np.linalg.norm(dm.pole_tide(lon, lat, np.array([0.1]), np.array([0.4]), np.array([60000.0]))) < 0.05
    amp = np.zeros((3, 11))
    amp[0, 0] = 0.01
    d = [dm.ocean_loading(amp, np.zeros((3, 11)), lon, lat, np.array([60000 + k / 48]), np.array([k * 7.5 + 100])) for k in range(48)]
    up = np.array([(x @ dm._local(lon, lat)[0][0])[0] for x in d])
    assert 0.009 < up.max() <= 0.01 + 1e-12 and -0.01 - 1e-12 <= up.min() < -0.009


def test_troposphere_and_ionosphere_functions(spark):
    el, lat = np.array([0.2, 0.7, 1.5]), np.array([0.1, -0.8, 1.2])
    m = dm.hydrostatic_mapping(el, lat, np.array([0.0, 500.0, 2000.0]), 100)
    assert np.all(np.abs(m * np.sin(el) - 1) < 0.05) and dm.zenith_hydrostatic(1013.25, 0.8, 0.0) == pytest.approx(2.307, abs=2e-3) and dm.standard_pressure(0) == 1013.25
    df = spark.createDataFrame(pd.DataFrame({"el": el, "lat": lat, "h": [0.0, 500.0, 2000.0]}))
    c = df.select(fc.hydrostatic_mapping(F.col("el"), F.col("lat"), F.col("h"), F.lit(100.0)), fc.wet_mapping(F.col("el"), F.col("lat")), fc.gradient_mapping(F.col("el")), fc.petrov_mapping(F.degrees("el"), 450e3, 6371e3), fc.single_layer_mapping(F.degrees("el"), 450e3, 6371e3)).collect()
    want = [m, dm.wet_mapping(el, lat), dm.gradient_mapping(el), dm.petrov_mapping(np.degrees(el), 450e3, 6371e3), dm.single_layer_mapping(np.degrees(el), 450e3, 6371e3)]
    assert np.allclose(np.array(c), np.array(want).T, rtol=1e-12)
    assert dm.tec_delay(1.0, 15.3667e9) == pytest.approx(5.693e-12, rel=1e-3)
    maps = dm.TecMaps(np.array([60000.0, 60000.5]), np.arange(-90, 91, 10.0), np.arange(-180, 181, 10.0), np.full((2, 19, 37), 20.0), np.full((2, 19, 37), 2.0))
    assert maps.vertical(np.array([60000.2]), np.array([10.0]), np.array([200.0])) == pytest.approx(20) and maps.uncertainty(np.array([60000.2]), np.array([10.0]), np.array([0.0])) == pytest.approx(2)
    zenith = maps.slant_delay(XYZ[None], np.array([60000.2]), np.array([0.0]), np.array([np.pi / 2 - 1e-3]), 8.4e9)
    assert zenith == pytest.approx(dm.tec_delay(20.0, 8.4e9), rel=0.2)
    one, two = {"a": np.array([1.0]), "b": np.array([2.0])}, {"a": np.array([4.0]), "b": np.array([6.0])}
    assert dm.baseline_correction(one, two, "a", 2.0) == (3.0, pytest.approx(2 * np.std([3, 4], ddof=1)))


def test_structure_delay_of_a_point_is_its_offset(spark):
    nu, w = 8.4e9 + np.arange(16) * 3e7, np.ones(16)
    got = dm.structure_delay(np.array([2.0]), np.array([1.5]), np.array([-0.7]), 0.01, 0.02, nu, w, 1.5)
    assert got == pytest.approx((0.01 * 1.5 - 0.02 * 0.7) * dm.MAS, rel=1e-9) and dm.structure_delay(np.array([]), np.array([]), np.array([]), 0.01, 0.02, nu, w, 1.5) == 0
    null = dm.structure_delay(np.array([1.0, 0.999]), np.array([0.0, 600.0]), np.array([0.0, 0.0]), 0.02, 0.0, nu, w, 0.3)
    assert np.isnan(null)
    rows = spark.createDataFrame([(1, "s", k, float(n), 1.0, 0.01, 0.02) for k, n in enumerate(nu)] + [(2, "none", k, float(n), 1.0, 0.01, 0.02) for k, n in enumerate(nu)], "row_key int, source string, chan int, nu double, w double, dtau_dra double, dtau_ddec double")
    models = spark.sql("SELECT 's' source, array(struct(2D flux, 1.5D x, -0.7D y), struct(0.4D flux, -2D x, 1D y)) components")
    both = {r["row_key"]: r["tau_structure"] for r in ast.structure_delays(rows, models).collect()}
    assert both[1] == pytest.approx(dm.structure_delay(np.array([2.0, 0.4]), np.array([1.5, -2.0]), np.array([-0.7, 1.0]), 0.01, 0.02, nu, w, 1.5), rel=1e-6) and both[2] == 0


def _context():
    t = np.arange(59990.0, 60010.0)
    eop = pd.DataFrame({"mjd": t, "ut1_utc": 0.1, "xp": 0.1, "yp": 0.3, "dx": 0.0, "dy": 0.0})
    maps = lambda x: dm.TecMaps(np.array([59999.0, 60001.0]), np.arange(-90, 91, 10.0), np.arange(-180, 181, 10.0), np.full((2, 19, 37), x), np.full((2, 19, 37), 2.0))
    return ast.ModelContext({"A": dm.Station(XYZ), "B": dm.Station(np.array([-1324009.0, -5332181.0, 3231962.0]))}, 60000.0, 56.0, 8.4e9, eop, {}, {"x": maps(20.0), "y": maps(24.0)}, "x")


def test_total_delays_add_up(spark):
    ctx = _context()
    keys = spark.createDataFrame([(float(t), "s", a, 1.0, 0.5) for t in (0, 60) for a in "AB"], "t double, source string, antenna string, ra double, dec double")
    terms = ast.antenna_terms(keys, ctx).cache()
    rec = spark.createDataFrame([(a, "s", 0.0, 100.0, [c, 1e-9], 2e-9 * c, 0.0) for a, c in (("A", 0.01), ("B", 0.02))], "antenna string, source string, start double, duration double, gdelay array<double>, clock double, dclock double")
    cor = ast.correlator_delays(keys.select("antenna", "source", "t", F.lit(1).alias("row_key")), rec)
    peaks = spark.createDataFrame([(k, 1, "s", "A", "B", 1, float(t), 3e-9, 0.0, 20.0, 1e-12) for k, t in enumerate((0, 60))], "obs_id int, scan int, source string, a1 string, a2 string, slot int, t double, delay double, rate double, snr double, sigma_delay double")
    obs = ast.total_delays(peaks, terms, cor, None, None, ctx).orderBy("obs_id").toPandas()
    assert np.allclose(obs.tau_total, obs.tau_correlator - 3e-9) and np.allclose(obs.tau_correlator, 0.01)
    assert np.allclose(obs.tau_residual, obs.tau_total - obs.tau_iono - obs.tau_model + obs.tau_clock)
    assert (obs.sigma_iono > 0).all() and np.allclose(obs.tau_clock, 2e-11)
    applied = ast.applied_phase_delay(
        spark.createDataFrame([(1, 1, 2, 1, 1, k, 8e9 + k * 1e6, 1.0) for k in range(5)], "row_key int, p int, q int, slot int, tcell int, chan int, nu double, w double"),
        spark.createDataFrame([(p, 1, 1, k, 2 * math.pi * p * 1e-9 * k * 1e6) for p in (1, 2) for k in range(5)], "p int, slot int, tcell int, chan int, phase double"))
    assert applied.first()["tau_applied"] == pytest.approx(1e-9)


def test_frame_rotation_and_error_model(spark):
    rng = np.random.default_rng(1)
    ra, dec = rng.uniform(0, 6.28, 40), rng.uniform(-1.3, 1.3, 40)
    r = np.array([0.3, -0.2, 0.5])
    dra = -np.sin(dec) * np.cos(ra) * r[0] - np.sin(dec) * np.sin(ra) * r[1] + np.cos(dec) * r[2]
    ddec = np.sin(ra) * r[0] - np.cos(ra) * r[1]
    df = spark.createDataFrame(pd.DataFrame({"ra": ra, "dec": dec, "dra": dra, "ddec": ddec}))
    assert np.allclose(ast.rotation_fit(df), r)
    d = rng.normal(size=3000) * np.sqrt((1.5 * 0.1) ** 2 + 0.2**2)
    best = ast.error_model(spark.createDataFrame(pd.DataFrame({"d": d, "formal": 0.1, "external": 0.0})), [1.5], [k / 100 for k in range(41)]).first()
    assert abs(best["f"] - 0.2) < 0.03 and best["chi2"] == pytest.approx(1, abs=0.1)


def test_catalogue_joins(spark):
    pos = spark.createDataFrame([("m", "s1", 1.0), ("m", "s2", 2.0)], "model_set string, source string, dra double")
    by = lambda rows, c: spark.createDataFrame(rows, f"source string, {c} double")
    cat = ast.catalogue(pos, by([("s1", 5.0)], "flux"), by([("s1", 6.0)], "peak"), spark.createDataFrame([("m", "s1", 7.0)], "model_set string, source string, chi2 double"), by([("s2", 8.0)], "ref")).orderBy("source").collect()
    assert cat[0]["flux"] == 5 and np.isnan(cat[1]["flux"]) and np.isnan(cat[0]["ref"]) and cat[1]["ref"] == 8
    with pytest.raises(Exception, match="not exactly once"):
        ast.strict_lookup(pos, by([("s1", 5.0), ("s1", 6.0), ("s2", 1.0)], "x"), "source").collect()
    floors = {r["model_set"]: r["floor"] for r in ast.displacement_floor(spark.createDataFrame([("m", "a", 1.0, 0.0), ("m", "b", 3.0, 0.0), ("n", "a", 9.0, 0.0), ("n", "b", 9.0, 1.0)], "model_set string, source string, shift double, structure double"), 0.5).collect()}
    assert floors == {"m": 2.0, "n": 9.0, None: 3.0}


def test_combining_bands(spark):
    chan = lambda *n: spark.createDataFrame([(float(x) * 1e6,) for x in n], "nu double")
    assert band_plan({"a": chan(1, 2, 3), "b": chan(2), "c": chan(10, 11)}, 1e6) == {"a": 1, "b": 1, "c": 2}
    for bad in ({"a": chan(1, 2), "b": chan(2, 3)}, {"a": chan(1, 5), "b": chan(3, 4, 9)}):
        with pytest.raises(ValueError):
            band_plan(bad, 1e6)
    kind = "p int, q int, source int, t double, nu double, i int, j int, re double, im double, w double, u double, v double, int_time double"
    a = spark.createDataFrame([(1, 2, 1, 0.0, 1e6, 1, 1, 1.0, 0.0, 1.0, 5.0, 6.0, 1.0), (1, 2, 1, 9.0, 1e6, 1, 1, 1.0, 0.0, 1.0, 5.0, 6.0, 1.0)], kind)
    c = spark.createDataFrame([(1, 2, 1, 0.0, 1e7, 1, 1, 2.0, 0.0, 1.0, 7.0, 8.0, 2.0)], kind)
    rows, vis = combine({"a": a, "c": c}, {"a": 1, "c": 2})
    got = {r["t"]: r for r in rows.collect()}
    assert (got[0.0]["u"], got[0.0]["n_bands"], got[9.0]["n_bands"]) == (5.0, 2, 1) and vis.count() == 3
    with pytest.raises(Exception, match="two rows of one key"):
        combine({"a": a, "b": a}, {"a": 1, "b": 1})[1].collect()
    near = near_duplicates(spark.createDataFrame([(1, 0.0, 1.0, 1), (1, 0.2, 1.0, 2), (1, 5.0, 1.0, 3)], "p int, t double, int_time double, row_id int"), ["p"])
    assert [r["row_id"] for r in near.collect()] == [2]
    with pytest.raises(Exception, match="conflict"):
        merged_dimension([spark.sql("SELECT 'a' k, 1 x"), spark.sql("SELECT 'a' k, 2 x")], "k", ["x"]).collect()


def test_fits_tables_images_and_copies(spark, tmp_path):
    n = 7
    flux = np.arange(n * 2 * 2 * 3, dtype="f4").reshape(n, 12)
    more = [fits.card(k, v) for k, v in (("MAXIS", 4), ("CTYPE1", "COMPLEX"), ("MAXIS1", 2), ("CTYPE2", "STOKES"), ("MAXIS2", 2), ("CTYPE3", "FREQ"), ("MAXIS3", 3), ("CTYPE4", "BAND"), ("MAXIS4", 1))]
    cols = {"UU": np.linspace(0, 1e-3, n), "VV": np.zeros(n), "WW": np.zeros(n), "DATE": np.full(n, 2460000.5), "TIME": np.arange(n) / 86400, "BASELINE": np.array([258] * (n - 1) + [257], "i4"), "SOURCE": np.ones(n, "i4"), "INTTIM": np.ones(n, "f4"), "WEIGHT": np.full((n, 2), -1.0, "f4"), "FLUX": flux, "NAME": np.array([b"ab"] * n)}
    cols["WEIGHT"][:, 0] = 2.0
    path = tmp_path / "x.fits"
    path.write_bytes(fits.header([fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 0)]) + fits.table_bytes("OTHER", {"A": np.arange(3, dtype="i4")}) + fits.table_bytes("UV_DATA", cols, more))
    df = fits.read_table(spark, str(path), "UV_DATA", rows_per_partition=3)
    assert df.count() == n and df.rdd.getNumPartitions() == 3 and df.first()["name"] == "ab"
    assert sorted(x for r in df.collect() for x in r["flux"]) == flux.ravel().tolist()
    assert [r[0] for r in fits.read_table(spark, str(path), "other").collect()] == [0, 1, 2]
    vis = fits.load_visibilities(spark, str(path))
    assert vis.count() == (n - 1) * 6 and vis.where("w < 0").count() == 0  # the autocorrelation is gone
    one = vis.where("t < 0.5").orderBy("chan", "prod").collect()
    assert [(r["re"], r["im"]) for r in one] == [(2 * k, 2 * k + 1) for k in range(6)] and [r["w"] for r in one] == [2.0, 0.0] * 3
    with pytest.raises(ValueError):
        fits.find_table(str(path), "NONE")
    image = np.arange(16.0).reshape(4, 4)
    raw = fits.image_bytes(image, fits.image_cards("s", 4, 0.1, 10.0, 20.0, (1.0, 0.5, 0.1), "2024-01-01", ["a" * 100]))
    assert len(raw) % 2880 == 0
    copy = fits.registered_copy(raw, 11.0, 21.0, ["moved"])
    h = fits.parse_cards(copy[: copy.index(b"END     ")])
    assert (h["CRVAL1"], h["CRVAL2"], h["NAXIS1"]) == (11.0, 21.0, 4) and h["HISTORY"] == ["a" * 72, "a" * 28, "moved"]
    data = np.frombuffer(copy[-2880:][:64], ">f4").reshape(4, 4, order="F")
    assert np.array_equal(data, image[::-1])
    assert fits.value_text(-0.1 / 3.6e6).strip().startswith("-2.777777777") and len(fits.value_text(-0.1 / 3.6e6)) == 20


def test_random_groups(spark, tmp_path):
    names = ["UU---SIN", "VV---SIN", "WW---SIN", "BASELINE", "DATE", "DATE", "INTTIM"]
    axes = [("COMPLEX", 3), ("STOKES", 2), ("FREQ", 2), ("IF", 2)]
    n = 5
    rec = np.zeros(n, np.dtype([("p", ">f4", (7,)), ("d", ">f4", (24,))]))
    rec["p"][:, 0], rec["p"][:, 3], rec["p"][:, 5], rec["p"][:, 6] = 2e-3, [258, 258, 259, 515, 257], np.arange(n) / 8, 2.0
    rec["d"] = np.arange(n * 24).reshape(n, 24)
    cards = [fits.card("SIMPLE", True), fits.card("BITPIX", -32), fits.card("NAXIS", 5), fits.card("NAXIS1", 0), *[fits.card(f"NAXIS{k}", m) for k, (_, m) in enumerate(axes, 2)], *[fits.card(f"CTYPE{k}", c) for k, (c, _) in enumerate(axes, 2)], fits.card("GROUPS", True), fits.card("PCOUNT", 7), fits.card("GCOUNT", n)]
    for k, name in enumerate(names, 1):
        cards += [fits.card(f"PTYPE{k}", name), fits.card(f"PSCAL{k}", 1.0), fits.card(f"PZERO{k}", 2460000.5 if k == 5 else 0.0)]
    path = tmp_path / "g.uvfits"
    path.write_bytes(fits.header(cards) + fits.padded(rec.tobytes()) + fits.table_bytes("OTHER", {"A": np.arange(2, dtype="i4")}))
    assert fits.read_table(spark, str(path), "OTHER").count() == 2
    vis = fits.load(spark, [str(path)])[str(path)]
    assert vis.count() == 4 * 8 and {(r["p"], r["q"]) for r in vis.select("p", "q").distinct().collect()} == {(1, 2), (1, 3), (2, 3)}
    first = vis.where("t < 1").orderBy("chan", "prod").collect()
    assert [r["re"] for r in first] == [3.0 * k for k in range(8)] and [r["w"] for r in first] == [3.0 * k + 2 for k in range(8)] and [r["if_id"] for r in first] == [1] * 4 + [2] * 4
    assert first[0]["u_m"] == pytest.approx(2e-3 * 299792458.0, rel=1e-6) and first[0]["int_time"] == 2.0
    assert sorted({round(r["t"]) for r in vis.select("t").collect()}) == [0, 10800, 21600, 32400]


def _tec(day, hours, value):
    rows = ["     1.0            IONOSPHERE MAPS     GPS                 IONEX VERSION / TYPE", "  6371.0".ljust(60) + "BASE RADIUS", "   450.0 450.0   0.0".ljust(60) + "HGT1 / HGT2 / DHGT", "    -1".ljust(60) + "EXPONENT", "".ljust(60) + "END OF HEADER"]
    for kind in ("TEC", "RMS"):
        for n, h in enumerate(hours, 1):
            rows += [f"{n:6d}".ljust(60) + f"START OF {kind} MAP", f"  2024     1{day:6d}{h:6d}     0     0".ljust(60) + "EPOCH OF CURRENT MAP"]
            for lat in (10.0, 0.0):
                rows += [f"  {lat:6.1f}{-10.0:6.1f}{10.0:6.1f}{10.0:6.1f}{450.0:6.1f}".ljust(60) + "LAT/LON1/LON2/DLON/H", "".join(f"{v:5d}" for v in (value, 9999, value + 1))]
            rows += [f"{n:6d}".ljust(60) + f"END OF {kind} MAP"]
    return "\n".join(rows)


def test_text_readers(spark, tmp_path):
    def eop(mjd, dx):
        line = [" "] * 190
        for a, text in ((8, f"{mjd:8.2f}"), (19, f"{0.1:9.6f}"), (38, f"{0.3:9.6f}"), (59, f"{-0.0123456:10.7f}"), (98, dx), (117, f"{-0.2:9.3f}")):
            line[a - 1 : a - 1 + len(text)] = text
        return "".join(line)

    (tmp_path / "eop").write_text("\n".join([eop(60000.0, f"{0.4:9.3f}"), eop(60001.0, " " * 9)]))
    got = readers.read_eop(spark, str(tmp_path / "eop")).collect()
    assert len(got) == 1 and got[0]["ut1_utc"] == -0.0123456 and got[0]["dx"] == pytest.approx(0.4e-3 * dm.ARCSEC)
    (tmp_path / "tec").mkdir()
    (tmp_path / "tec" / "a.i").write_text(_tec(1, (0, 23), 100))
    (tmp_path / "tec" / "b.i.gz").write_bytes(gzip.compress(_tec(1, (23,), 200).encode()))
    maps = readers.read_tec_maps(spark, str(tmp_path / "tec" / "*")).toPandas()
    assert len(maps) == 12 and set(maps.tec.dropna()) == {10.0, 10.1} and maps.tec.isna().sum() == 4 and set(maps.lat) == {0.0, 10.0}
    (tmp_path / "names").write_text("source_name\trfc_jname\na\tJ0001+3602\nb\tJ2346+0930\n")
    assert readers.read_source_names(spark, str(tmp_path / "names")).count() == 2
    (tmp_path / "names").write_text("source_name\trfc_jname\nb\tJ0001+3602\na\tJ2346+0930\n")
    with pytest.raises(ValueError):
        readers.read_source_names(spark, str(tmp_path / "names"))
    (tmp_path / "g.toml").write_text("[antennas.AA]\nxyz=[1.0,2.0,3.0]\nvelocity=[0.1,0.0,0.0]\nepoch=2020.0\n")
    assert readers.read_geometry(spark, str(tmp_path / "g.toml"), 2030.0).first()["x"] == pytest.approx(2.0)
    (tmp_path / "s1_x.mod").write_text("! comment\n1.5v 2.0v 90.0v\n0.5 1.0 0.0\n")
    m = readers.read_models(spark, str(tmp_path / "*.mod")).orderBy("flux").collect()
    assert [(r["source"], r["flux"]) for r in m] == [("s1", 0.5), ("s1", 1.5)] and m[1]["x"] == pytest.approx(2.0)
    chans = spark.createDataFrame([(1, 8e9, 1), (2, 8.1e9, 1)], "chan int, nu double, if_id int")
    sim = readers.simulate(spark, 3, [0.0, 1.0], chans, single=[2])
    assert sim.count() == 3 * 2 * 2 * 4 and sim.where("w = 0").count() == 2 * 2 * 2 * 2
    w = readers.pressure_series(spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 900.0), (1, 2.0, float("nan"))], "antenna_no int, t double, pressure double"))
    assert [r["pressure"] for r in w.collect()] == [900.0]
    iv, cl = spark.sql("SELECT 1D t, 1 antenna_no, 's' source, array(1D) gdelay"), spark.sql("SELECT 2D t, 1 antenna_no, 's' source, 1D clock")
    with pytest.raises(Exception, match="do not match"):
        readers.correlator_model(iv, cl).collect()


def test_compressed_z_files():
    data = b"abcabcabcabcabcabc" * 50
    table, out, code_bits, width, w = {bytes([k]): k for k in range(256)}, [], 0, 9, b""
    next_code = 257
    bits, groups = [], 0
    for b in data:  # a plain 9-bit writer; the input is short enough never to need ten bits
        if w + bytes([b]) in table:
            w += bytes([b])
        else:
            bits.append(table[w])
            if next_code < 512:
                table[w + bytes([b])] = next_code
                next_code += 1
            w = bytes([b])
    bits.append(table[w])
    assert len(bits) < 250
    value = sum(c << (9 * k) for k, c in enumerate(bits))
    raw = b"\x1f\x9d\x90" + value.to_bytes((9 * len(bits) + 7) // 8, "little")
    assert readers._uncompress(raw) == data
    del out, code_bits, width, groups


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a,x", 0.1)], "source string, dra double")
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(df.where("false"), str(tmp_path / "u"))
    paths = sinks.write_catalogue(df, str(tmp_path / "c"), {"dra": "mas"}, {"n": 2}, ["source"])
    assert paths[1].read_text().splitlines() == ["source,dra", '"a,x",0.1', "b,1.5"] and '"unit": "mas"' in paths[0].read_text()
    im = spark.createDataFrame([("s", 4, 0.1, [0.0] * 16, 1.0, 2.0, 1.0, 0.5, 0.1)], "source string, npix int, pixel double, restored array<double>, ra_deg double, dec_deg double, sigma_major double, ratio double, pa double")
    row = sinks.write_images(im, str(tmp_path / "i"), "2024-01-01", ["x"]).first()
    assert row["bytes"] % 2880 == 0
    sinks.write_report(str(tmp_path / "c"), "title", {"rows": 2}, {"table": df})
    text = sinks.write_manifest(str(tmp_path / "c"), {"name": "x"}).read_text()
    assert 'name = "x"' in text and "report.md" in text and "catalogue.csv" in text
    with pytest.raises(ValueError):
        sinks.write_report(str(tmp_path / "c"), "t", {}, {"t": df}, most_rows=1)


def test_schedule_and_inspector(spark):
    rng = np.random.default_rng(4)
    vis = _vis(spark, rng.normal(size=6) * 5e-9, rng.normal(size=6) * 3e-3, rng.normal(size=6)).withColumn("hcell", F.lit(1)).withColumn("acell", F.lit(1))
    cells = spark.createDataFrame([(1, 5.5)], "cell int, ref double"), spark.createDataFrame([(1, 8.4075e9)], "cell int, ref double")
    zero = Solution(spark.createDataFrame([], "kind string, p int, i int, tcell int, fcell int, value double"), *cells)
    search = Search((-0.05, 0.05), (-1e-7, 1e-7))
    align = spark.createDataFrame([("Delay", 1, 1, 1, 1e-10)], "kind string, p int, i int, fcell int, value double")
    out = run(vis, zero, [alignment_step(align), Capture("first", fringe_step(1e6, search, ["PhaseOffset", "Delay", "Rate"], 4.0, 1)), Capture("again", measure_step(1e6, search)), bandpass_step(10, 1e-6, (1, 1))])
    assert len(out.solutions) == 5 and len(out.seconds) == 4 and set(out.products) == {"first", "again"}
    assert out.products["again"].agg(F.max(F.abs("delay"))).first()[0] < 1e-9
    sol = out.solutions[3]
    model = {(r["p"], r["q"], r["chan"], r["i"]): r["phase"] for r in ui.grid_model(vis, sol, 0, 99).collect()}
    data = {(r["p"], r["q"], r["chan"], r["i"]): r["phase"] for r in ui.grid_data(vis, None, 5, 6).collect()}
    assert np.median([abs(np.angle(np.exp(1j * (data[k] - model[k])))) for k in data]) < 0.2
    assert ui.node_value(sol, "Delay", 1, 1, 1, 1) != 0 and ui.node_value(sol, "Delay", 9, 1, 1, 1) == 0 and ui.varying_axis(sol, "Delay") == "tcell"
    occupied = spark.createDataFrame([(1, 1, 1, 1)], "antenna int, slot int, tcell int, fcell int")
    assert ui.traces(sol, occupied, "Delay", "tcell").count() == 1
    lines = ui.timelines(spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0 + 1e-9), ("c", 0.0, 2.0), ("d", 0.0, 1.0), ("d", 3.0, 4.0)], "name string, lo double, hi double"))
    assert sorted((r["names"], [tuple(c) for c in r["cells"]]) for r in lines.collect()) == [(["a", "b"], [(0.0, 1.0)]), (["c"], [(0.0, 2.0)]), (["d"], [(0.0, 1.0), (3.0, 4.0)])]
    memo = ui.Memo()
    a = memo.get("x", 1, lambda: vis)
    assert memo.get("x", 1, lambda: None) is a and memo.get("x", 2, lambda: occupied).count() == 1
    p, q = ui.mark_phase(sol, 1, 1, 1, 1, 5.0, 8.4e9), ui.mark_phase(sol, 2, 1, 1, 1, 5.0, 8.4e9)
    z = calibrate(vis.where("p = 1 and q = 2 and i = 1 and t = 5 and chan = 0"), sol, sol.kinds()).first()
    w = vis.where("p = 1 and q = 2 and i = 1 and t = 5 and chan = 0").first()
    assert np.angle(complex(w["re"], w["im"]) / complex(z["re"], z["im"]) * np.exp(-1j * (p - q))) == pytest.approx(0, abs=1e-9)
    stopped = run(vis, zero, [alignment_step(align)], cancelled=lambda: True)
    assert len(stopped.solutions) == 1


def test_configuration():
    c = SessionConfig("s", "x.fits", "AA", "/tmp/w", members=(ExternalModels("e", "{src}_{epoch}.mod"), OwnImaging(variants=(("fine", {"pixel": 0.1}),))))
    assert c.model_sets() == ["e", "own", "own-fine"] and c.own_imaging().npix == 128 and [m.label for m in c.external()] == ["e"] and c.delay_fit().reference_antenna == "AA"
    with pytest.raises(ValueError):
        SessionConfig("s", "x", "AA", "/tmp", members=(OwnImaging(), OwnImaging()))


def test_streams(spark, tmp_path):
    rows = [("a", float(t), 0.5 * t % 6.28, 1.0, 0.0, 2.0, f"2024-01-01 00:{int(t) // 60:02d}:{int(t) % 60:02d}") for t in (0, 10, 20, 300, 310)] + [("end", 9e4, 0.0, 1.0, 0.0, 1.0, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "antenna string, t double, phase double, re double, im double, w double, at string").withColumn("datetime", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def drain(s, name):
        q = s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.sql(f"SELECT * FROM {name}").collect()

    scans = drain(twins.scans(stream(), ["antenna"], "60 seconds", "10 seconds"), "scans")
    assert sorted(r["n"] for r in scans if r["antenna"] == "a") == [2, 3]
    means = drain(twins.averages(stream(), ["antenna"], "100 seconds", "10 seconds"), "means")
    assert sorted(r["n"] for r in means if r["antenna"] == "a") == [2, 3] and all(r["re"] == 1.0 for r in means)
    un = sorted((r["t"], r["unwrapped"]) for r in drain(twins.unwrapped(stream(), "10 seconds"), "un") if r["antenna"] == "a")
    assert all(abs(b[1] - a[1]) <= math.pi + 1e-9 for a, b in zip(un, un[1:]))
    flags = spark.createDataFrame([("a", 5.0, 15.0)], "antenna string, r_lo double, r_hi double")
    kept = drain(twins.unflagged(stream().withColumn("lo", F.col("t")).withColumn("hi", F.col("t") + 1), flags, "10 seconds"), "kept")
    assert sorted(r["t"] for r in kept if r["antenna"] == "a") == [0, 20, 300, 310]
