"""Kernels against known truth and identities; the Spark wrappers on small synthetic data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.functions import fringemath as fm
from vislake.functions import graphmath as gm
from vislake.functions import imagemath as im
from vislake.operators.bandpass import condense, condense_amplitudes, normalized, solve_amplitudes, solve_bandpass, weighted_quantile, weighted_quantile_column
from vislake.operators.closure import closure_chi2, edges, stokes_i
from vislake.operators.estimate import MAS, DelayFit, combine_positions, fit, fit_sessions, floor_variance, solve_normal
from vislake.operators.fringe import fringe_fit, fringe_planes, fringe_self, solve_nodes
from vislake.operators.gains import Solution, calibrate
from vislake.operators.imaging import cleaned_flux, components_of, dirty_pixels, gridded, hybrid, image_sources

SEARCH = fm.Search((-0.05, 0.05), (-1e-7, 1e-7))


def test_smooth_length_is_the_smallest():
    smooth = sorted(2**a * 3**b * 5**c for a in range(12) for b in range(8) for c in range(6))
    for n in range(1, 400):
        assert fm.smooth_length(n) == next(m for m in smooth if m >= n)


def test_lattice_fills_gaps_and_rejects_irregular_times():
    x = np.array([0.0, 1.0, 2.0, 5.0, 6.0]) * 2.0 + 10
    lat = fm.uniform_lattice(x)
    assert (lat.origin, lat.step, lat.n) == (10.0, 2.0, 7)
    assert lat.snap(x).tolist() == [0, 1, 2, 5, 6]
    assert fm.uniform_lattice(np.array([3.0])).n == 1
    with pytest.raises(ValueError):
        fm.assert_uniform(fm.Lattice(0.0, 1.0, 9), np.arange(0, 9, 1.5))


def test_transform_equals_the_direct_sum():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(6, 8)) + 1j * rng.normal(size=(6, 8))
    tl, fl = fm.Lattice(5.0, 2.0, 6), fm.Lattice(8.4e9, 1e6, 8)
    g, rate, delay = fm.transform(s, tl, fl, (-0.1, 0.1), (-3e-7, 3e-7), (2, 2))
    t, nu = tl.points() - 5.0, fl.points() - 8.4e9
    direct = np.einsum("ab,ra,db->rd", s, np.exp(-2j * np.pi * np.outer(rate, t)), np.exp(-2j * np.pi * np.outer(delay, nu)))
    assert np.allclose(g, direct)
    with pytest.raises(ValueError):
        fm.transform(s, tl, fl, (10, 11), (-1, 1), (2, 2))


def test_noise_region_is_the_far_quarter():
    region = fm.noise_region((8, 8), 4, 4)
    assert len(region) == 16
    r, d = region % 8, region // 8
    assert np.minimum(abs(r - 4), abs(d - 4)).min() >= 2
    assert len(fm.noise_region((1, 3), 0, 0)) == 0


def test_graph_components_and_solve_recover_nodes():
    rng = np.random.default_rng(2)
    true = {n: rng.normal(size=3) * [1e-9, 1e-3, 1.0] for n in range(1, 9)}
    pairs = [(1, 3), (3, 5), (1, 5), (5, 7), (2, 4), (4, 6), (2, 6)]
    e = {k: [] for k in ("p", "i", "q", "j", "delay", "rate", "re", "im", "snr", "q11", "q12", "q22", "q_ab")}
    for a, b in pairs:
        d = true[a] - true[b]
        for k, v in (("p", (a + 1) // 2), ("i", (a - 1) % 2 + 1), ("q", (b + 1) // 2), ("j", (b - 1) % 2 + 1), ("delay", d[0]), ("rate", d[1]), ("re", np.cos(d[2])), ("im", np.sin(d[2])), ("snr", 50.0), ("q11", 4.0), ("q12", 0.1), ("q22", 9e18), ("q_ab", 20.0)):
            e[k].append(v)
    e = {k: np.array(v) for k, v in e.items()}
    for kind in (gm.SNR_WEIGHTED, gm.CURVATURE_WEIGHTED):
        got = gm.stationize(e, kind, 200, 3, 1e-3, 1e-9)
        assert len(got["p"]) == 7
        for comp, anchor in (([1, 3, 5, 7], 5), ([2, 4, 6], 6)):
            for n in comp:
                k = int(np.flatnonzero((got["p"] == (n + 1) // 2) & (got["i"] == (n - 1) % 2 + 1))[0])
                d = true[n] - true[anchor]
                assert np.isclose(got["delay"][k], d[0], atol=1e-15) and np.isclose(got["rate"][k], d[1], atol=1e-9)
                assert np.isclose(np.angle(np.exp(1j * (got["phase"][k] - d[2]))), 0, atol=1e-6)
        assert got["anchored"].all()


def _vis(spark, tau, rho, phi, n_t=12, n_c=16, noise=0.05, seed=3):
    """Three antennas, one source, one tile, two slots; node delays, rates and phases as given."""
    rng = np.random.default_rng(seed)
    rows = []
    for p, q in ((1, 2), (1, 3), (2, 3)):
        for i in (1, 2):
            a, b = 2 * (p - 1) + i - 1, 2 * (q - 1) + i - 1
            for t in range(n_t):
                for c in range(n_c):
                    nu = 8.4e9 + c * 1e6
                    ph = phi[a] - phi[b] + 2 * np.pi * ((tau[a] - tau[b]) * (nu - 8.4075e9) + (rho[a] - rho[b]) * (t - 5.5))
                    z = np.exp(1j * ph) + noise * (rng.normal() + 1j * rng.normal())
                    rows.append((1, 1, 1, p, q, i, i, float(t), nu, c, z.real, z.imag, 1.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["tcell", "fcell", "source", "p", "q", "i", "j", "t", "nu", "chan", "re", "im", "w"])).selectExpr("int(tcell) tcell", "int(fcell) fcell", "int(source) source", "int(p) p", "int(q) q", "int(i) i", "int(j) j", "t", "nu", "int(chan) chan", "re", "im", "w")


def test_fringes_graph_and_self_calibration(spark):
    rng = np.random.default_rng(4)
    tau, rho, phi = rng.normal(size=6) * 5e-9, rng.normal(size=6) * 3e-3, rng.normal(size=6)
    vis = _vis(spark, tau, rho, phi)
    fringes = fringe_fit(vis, 1e6, SEARCH).cache()
    for r in fringes.collect():
        a, b = 2 * (r["p"] - 1) + r["i"] - 1, 2 * (r["q"] - 1) + r["j"] - 1
        assert abs(r["delay"] - (tau[a] - tau[b])) < 5 * r["sigma_delay"] + 2e-10
        assert abs(r["rate"] - (rho[a] - rho[b])) < 1e-3 and r["snr"] > 5  # the sidelobes of so small a plane are its noise
    nodes = solve_nodes(fringes, gm.SNR_WEIGHTED, 100, 1)
    cells = spark.createDataFrame([(1, 5.5)], "cell int, ref double"), spark.createDataFrame([(1, 8.4075e9)], "cell int, ref double")
    zero = spark.createDataFrame([], "kind string, p int, i int, tcell int, fcell int, value double")
    sol = fringe_self(Solution(zero, *cells), nodes, ["PhaseOffset", "Delay", "Rate"])
    left = calibrate(vis, sol, ["PhaseOffset", "Delay", "Rate"]).groupBy("p", "q", "i", "j").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).collect()
    assert all(r["re"] > 0.97 and abs(r["im"]) < 0.1 for r in left)
    peak = fringe_planes(vis, 1e6, SEARCH).groupBy("p", "q", "i", "j").agg(F.max_by("delay", "magnitude").alias("d"))
    assert all(abs(r["d"] - (tau[2 * (r["p"] - 1) + r["i"] - 1] - tau[2 * (r["q"] - 1) + r["j"] - 1])) < 2e-8 for r in peak.collect())


def test_fringe_edge_cases(spark):
    vis = _vis(spark, np.zeros(6), np.zeros(6), np.zeros(6), n_t=3, n_c=4)
    assert fringe_fit(vis.where("false"), 1e6, SEARCH).count() == 0
    one = fringe_fit(vis.where("t = 0"), 1e6, SEARCH).collect()
    assert one and all(r["snr"] is None and r["weight"] > 0 for r in one)
    with pytest.raises(Exception, match="two rows on one time"):
        fringe_fit(vis.union(vis), 1e6, SEARCH).collect()
    assert fringe_fit(vis.union(vis), 1e6, SEARCH, strict=False).count() == 6


def test_weighted_quantile(spark):
    x, w = np.array([3.0, 1.0, 2.0, 5.0]), np.array([1.0, 2.0, 1.0, 1.0])
    spread = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "w": w}))
    for q in (0.2, 0.5, 0.9):
        assert np.isclose(weighted_quantile_column(spread, ["g"], "x", "w", q).first()["value"], weighted_quantile(x, w, q))
    assert 1.0 <= weighted_quantile(x, w, 0.1) < weighted_quantile(x, w, 0.9) <= 5.0


def test_bandpass_recovers_the_ripple_up_to_a_common_phase(spark):
    rng = np.random.default_rng(5)
    b = np.exp(rng.normal(size=(4, 6)) * 0.1 + 1j * rng.normal(size=(4, 6)) * 0.4)
    rows = []
    for h in range(6):
        for p in range(4):
            for q in range(p + 1, 4):
                c = np.exp(1j * rng.normal())
                for k in range(6):
                    z = b[p, k] * c * np.conj(b[q, k])
                    rows.append((1, p + 1, q + 1, 1, 1, h, 1, 1, k, z.real, z.imag, 1.0))
    vis = spark.createDataFrame(pd.DataFrame(rows, columns=["source", "p", "q", "i", "j", "hcell", "acell", "tcell", "k", "re", "im", "w"]))
    got = solve_bandpass(condense(vis), 200, 1e-6, (1, 1)).toPandas()
    for p in range(4):
        g = got[got.p == p + 1].sort_values("k")
        want = np.unwrap(np.angle(b[p] * np.conj(b[0] / abs(b[0]))))
        d = np.angle(np.exp(1j * (g["phase"].to_numpy() - want)))
        assert np.allclose(d - d.mean(), 0, atol=2e-2)
        d = g["log_amp"].to_numpy() - np.log(abs(b[p]))
        assert np.allclose(d - d.mean(), 0, atol=2e-2)


def test_amplitude_self_calibration(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=5) * 0.2
    rows = [(1, 1, 1, 1, p + 1, q + 1, float(np.exp(a[p] + a[q]) * (1 + 0.001 * rng.normal())), 0.0, 100.0, 1.0, 0.0, 1.0) for p in range(5) for q in range(p + 1, 5) for _ in range(4)]
    vis = spark.createDataFrame(pd.DataFrame(rows, columns=["i", "j", "tcell", "fcell", "p", "q", "re", "im", "w", "model_re", "model_im", "model_flux"]))
    solved = solve_amplitudes(condense_amplitudes(vis, 1.0, 3.0, 0.1), 1e-9)
    got = solved.toPandas().sort_values("p")
    assert np.allclose(got["a"], a, atol=2e-3) and (got["rms_after"] < got["rms_before"]).all()
    assert abs(normalized(solved, "percell").agg(F.sum(F.col("a") * F.col("info"))).first()[0]) < 1e-6
    assert solve_amplitudes(condense_amplitudes(vis.where("p = 1 and q = 2"), 1.0, 3.0, 0.1), 1e-9).count() == 0


def _sky(spark, seed=7, n=300):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=n) * 0.15, rng.normal(size=n) * 0.1
    z = 2.0 + 1.0 * np.exp(2j * np.pi * (u * 6.0 - v * 4.0))
    return u, v, z


def test_clean_is_exact_and_finds_both_components(spark):
    u, v, z = _sky(spark)
    grid, w = im.Grid(32, 1.0), np.ones(len(u))
    dirty, patch = im.dirty_map(u, v, z, w, grid), im.dirty_beam(u, v, w, grid)
    flux, residual, _ = im.hogbom(dirty, patch, 0.1, 400, 0.01)
    axis = grid.axis()
    model = sum(flux[x, y] * np.exp(2j * np.pi * (u * axis[x] + v * axis[y])) for x, y in zip(*np.nonzero(flux)))
    assert np.allclose(residual, im.dirty_map(u, v, z - model, w, grid), atol=1e-9)
    assert abs(flux[16, 16] - 2.0) < 0.1 and abs(flux[22, 12] - 1.0) < 0.1
    with pytest.raises(ValueError):
        im.hogbom(dirty, patch, 0.1, 5, 0.01, np.zeros_like(dirty, bool))
    with pytest.raises(ValueError):
        im.beam_moments(np.ones(3), np.ones(3), np.ones(3))


def test_image_sources_on_spark(spark):
    u, v, z = _sky(spark)
    pdf = pd.DataFrame({"row_id": 1, "source": 4, "p": 1, "q": 2, "scan": 1, "t": np.arange(len(u)), "chan": 1, "u": u, "v": v, "re": z.real, "im": z.imag, "w": 1.0}).astype({"source": "int32"})
    stokes = spark.createDataFrame(pdf)
    grid = im.Grid(32, 1.0)
    images, _ = hybrid(stokes, lambda divided: stokes, 1, 0.1, grid=grid, gain=0.1, niter=400, sigmas=3.0, weight_scale=100.0, window=lambda d, g: im.disk(d, g, 12.0))
    row = images.first()
    assert abs(row["peak_x"]) < 0.5 and abs(row["peak_y"]) < 0.5 and row["peak"] > 1.8
    assert abs(cleaned_flux(images).first()["flux"] - 3.0) < 0.3
    assert components_of(images).first()["components"][0]["flux"] > 1.5
    small = dirty_pixels(stokes, 8, 2.0).toPandas()
    direct = im.dirty_map(u, v, z, np.ones(len(u)), im.Grid(8, 2.0))
    at = {(x, y): direct[a, b] for a, x in enumerate(im.Grid(8, 2.0).axis()) for b, y in enumerate(im.Grid(8, 2.0).axis())}
    assert all(np.isclose(r.value, at[r.x, r.y]) for r in small.itertuples())
    assert gridded(stokes, 1e-6).count() == len(u)
    line = stokes.withColumn("v", F.col("u"))
    assert image_sources(line, grid, 0.1, 10, 3.0, 1.0).first()["dirty"] is None


def test_closures_do_not_feel_antenna_gains(spark):
    rng = np.random.default_rng(8)
    rows = []
    for t in range(3):
        for p in range(1, 5):
            for q in range(p + 1, 5):
                z = 1 + 0.4 * np.exp(1j * rng.normal())
                rows.append((1, 1, p, q, 1, float(t), 1, 0.1, 0.2, float(z.real), float(z.imag), 5.0))
    s = spark.createDataFrame(rows, "row_id int, source int, p int, q int, scan int, t double, chan int, u double, v double, re double, im double, w double")
    a = closure_chi2(edges(s, 1.0), ["source"]).first()
    g = np.exp(1j * rng.normal(size=5))
    turn = F.expr("case " + " ".join(f"when p = {p} and q = {q} then {np.angle(g[p] * np.conj(g[q]))}" for p in range(1, 5) for q in range(p + 1, 5)) + " end")
    c = s.withColumn("ph", turn).selectExpr("row_id", "source", "p", "q", "scan", "t", "chan", "u", "v", "re*cos(ph)-im*sin(ph) re", "re*sin(ph)+im*cos(ph) im", "w")
    b = closure_chi2(edges(c, 1.0), ["source"]).first()
    assert np.isclose(a["chi2"], b["chi2"]) and a["n"] == b["n"] == 12


def test_solve_normal_and_floor():
    x, cov, how = solve_normal(np.array([[4.0, 0, 1], [0, 0, 0], [1, 0, 3]]), np.array([1.0, 5.0, 2.0]))
    assert how == "cholesky" and x[1] == 0 and np.allclose(np.array([[4, 1], [1, 3]]) @ x[[0, 2]], [1, 2]) and (cov[1] == 0).all()
    assert solve_normal(np.ones((2, 2)), np.ones(2))[2] == "pseudoinverse"
    r = np.random.default_rng(9).normal(size=2000) * 3
    assert np.isclose(floor_variance(r, np.ones(2000), 1.0), np.mean(r**2) - 1, rtol=1e-6)
    assert floor_variance(r, np.full(2000, 100.0), 1.0) == 0


def test_estimator_recovers_positions_and_rejects_outliers(spark):
    rng = np.random.default_rng(10)
    ants, srcs = ["AA", "BB", "CC", "DD"], ["s1", "s2", "s3"]
    off = {s: rng.normal(size=2) * 0.5 * MAS for s in srcs}
    clock, zwd = {"AA": 0.0, "BB": 3e-9, "CC": -2e-9, "DD": 1e-9}, {a: abs(rng.normal()) * 1e-10 for a in ants}
    rows, bad = [], set()
    for n in range(700):
        a1, a2 = rng.choice(ants, 2, replace=False)
        s = rng.choice(srcs)
        el = rng.uniform(0.3, 1.4, 2)
        part = rng.normal(size=2) * 0.02
        wet = 1 / np.sin(el)
        tau = part @ off[s] + clock[a2] - clock[a1] + zwd[a2] * wet[1] - zwd[a1] * wet[0] + rng.normal() * 5e-12
        if n % 100 == 7:
            tau += 2e-9
            bad.add(n)
        rows.append((n, s, a1, a2, 1, float(rng.uniform(0, 7000)), tau, 5e-12, 1e-12, part[0], part[1], wet[0], wet[1], 0.0, 0.0, 0.1, 0.2, 50.0 if n else 1.0, el[0], el[1]))
    cols = "obs_id bigint, source string, a1 string, a2 string, slot int, t double, tau_residual double, sigma_tau double, sigma_iono double, dtau_dra double, dtau_ddec double, wet1 double, wet2 double, grad1 double, grad2 double, az1 double, az2 double, snr double, el1 double, el2 double"
    obs = spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], cols)
    f = fit(DelayFit("AA", robust_iterations=2, sigma_floor_init=1e-12), obs)
    got = f.positions().set_index("source")
    for s in srcs:
        assert abs(got.loc[s, "dra_mas"] - off[s][0] / MAS) < 5 * got.loc[s, "sigma_ra_mas"] + 1e-3
        assert abs(got.loc[s, "ddec_mas"] - off[s][1] / MAS) < 5 * got.loc[s, "sigma_dec_mas"] + 1e-3
    out = {r["obs_id"] for r in f.rows.where("not accepted").collect()}
    assert bad <= out and len(out) < 30 and f.rows.count() == 699
    assert np.allclose(f.by_antenna("clock")["BB"], 3e-9, atol=1e-10) and f.layout.names()[0] == "ra[s1]"


def test_sessions_have_their_own_clocks(spark):
    rng = np.random.default_rng(11)
    ants, srcs = ["AA", "BB", "CC", "DD"], ["s1", "s2", "s3"]
    off = {s: rng.normal(size=2) * 0.5 * MAS for s in srcs}
    rows = []
    for session, clock in (("x", {"AA": 0.0, "BB": 3e-9, "CC": -2e-9, "DD": 1e-9}), ("y", {"BB": 0.0, "CC": 8e-9, "DD": -6e-9})):
        for n in range(500):
            a1, a2 = rng.choice(sorted(clock), 2, replace=False)
            s, el, part = rng.choice(srcs), rng.uniform(0.3, 1.4, 2), rng.normal(size=2) * 0.02
            tau = part @ off[s] + clock[a2] - clock[a1] + rng.normal() * 5e-12
            rows.append((session, n, str(s), str(a1), str(a2), 1, *map(float, (rng.uniform(0, 7000), tau, 5e-12, 1e-12, *part, *(1 / np.sin(el)), 0, 0, 0.1, 0.2, 50, *el))))
    cols = "session string, obs_id bigint, source string, a1 string, a2 string, slot int, t double, tau_residual double, sigma_tau double, sigma_iono double, dtau_dra double, dtau_ddec double, wet1 double, wet2 double, grad1 double, grad2 double, az1 double, az2 double, snr double, el1 double, el2 double"
    spec = DelayFit("AA", sigma_floor_init=1e-12)
    obs = spark.createDataFrame(rows, cols).cache()
    each = fit_sessions(spec, obs).cache()
    got = combine_positions(each).toPandas().set_index("source")
    for s in srcs:
        assert abs(got.loc[s, "dra_mas"] - off[s][0] / MAS) < 5 * got.loc[s, "sigma_ra_mas"] < 0.05 and got.loc[s, "n_sessions"] == 2
        assert abs(got.loc[s, "ddec_mas"] - off[s][1] / MAS) < 5 * got.loc[s, "sigma_dec_mas"]
    # One session alone is what the distributed fit gives.
    one, plain = combine_positions(each.where("session = 'x'")).toPandas().set_index("source"), fit(spec, obs.where("session = 'x'")).positions().set_index("source")
    assert np.allclose(one.loc[srcs, "dra_mas"], plain.loc[srcs, "dra_mas"], atol=1e-6) and np.allclose(one.loc[srcs, "sigma_ra_mas"], plain.loc[srcs, "sigma_ra_mas"], rtol=1e-4)
