"""Strategies, seeds, injections, contexts, outside models, and the sharded helpers against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_models import _tec
from test_whatif import SPEC, observables  # noqa: F401
from vislake.functions import delaymodel as dm
from vislake.functions.imagemath import Grid
from vislake.operators import gains, whatif
from vislake.operators.bandpass import solve_bandpass, solve_bandpass_wide
from vislake.operators.closure import exact_median
from vislake.operators.gains import Solution, calibrate, corrupt, install_static
from vislake.operators.imaging import beam_matched_correlation, best_seed, image_by_receptor
from vislake.operators.partition import STRATEGIES, _numbered, by_scan, gap_scans, listed_scans, time_mode, whole
from vislake.operators.timejoin import merged_intervals, overlapping
from vislake.plans import inspect as ui
from vislake.plans import session_run as sr
from vislake.plans.config import ExternalModels, OwnImaging, PointSource, SessionConfig
from vislake.session import cut, stored
from vislake.sources import fits, readers, sinks


def _vis(spark):
    rows = [(k, 1, p, q, 1, 1, float(t), 8.4e9 + c * 1e6, c, i, j, 1.0 + p, 0.5 * q, 2.0) for k, (p, q, t, c, i, j) in enumerate((p, q, t, c, i, j) for p in (1, 2) for q in (2, 3) if p < q for t in range(3) for c in range(3) for i in (1, 2) for j in (1, 2))]
    return spark.createDataFrame(rows, "row_id int, source int, p int, q int, tcell int, fcell int, t double, nu double, chan int, i int, j int, re double, im double, w double")


def test_intervals_of_all_lengths_meet_once(spark):
    rng = random.Random(1)
    make = lambda n, most: [(k, rng.choice("ab"), a, a + rng.choice([0.0, 1.0, rng.random() * most])) for k in range(n) for a in [rng.random() * 1e6]]
    left, right = make(200, 1e3) + [(900, "a", 0.0, 1e6), (901, "b", float("nan"), 1.0), (902, "b", 5.0, 4.0), (903, None, 0.0, 1.0)], make(150, 5e5) + [(800, "a", -1e6, 2e6)]
    ls, rs = spark.createDataFrame(left, "row_key int, k string, lo double, hi double"), spark.createDataFrame(right, "cell int, k string, r_lo double, r_hi double")
    got = sorted((r["row_key"], r["cell"]) for r in overlapping(ls, rs, ["k"], 10.0).collect())
    want = sorted((a, b) for a, k, lo, hi in left for b, k2, r_lo, r_hi in right if k == k2 and lo <= hi and lo <= r_hi and r_lo <= hi)
    assert got == want
    assert {r["row_key"] for r in overlapping(ls, rs, ["k"], 10.0, "left_semi").collect()} == {a for a, _ in want}
    assert overlapping(ls.where("false"), rs, ["k"], 10.0).count() == 0


def test_intervals_merge_across_shards(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), a, a + rng.choice([0.0, 0.5, 30.0])) for _ in range(300) for a in [float(rng.randrange(0, 500))]] + [("a", None, 1.0), ("b", 3.0, 2.0), ("a", 1.0, float("nan"))]
    got = sorted((str(r["k"]), r["r_lo"], r["r_hi"]) for r in merged_intervals(spark.createDataFrame(rows, "k string, r_lo double, r_hi double"), ["k"], shard=17.0).collect())
    want = []
    for key in ("a", "b", None):
        end = None
        for lo, hi in sorted((a, b) for k, a, b in rows if k == key and a is not None and a <= b):
            if end is None or lo > end:
                want.append([str(key), lo, hi])
                end = hi
            end = want[-1][2] = max(end, hi)
    assert got == sorted(map(tuple, want))


def test_numbers_are_the_same_in_shards(spark):
    df = spark.createDataFrame([(k * 7, k % 3 + 1) for k in range(50)], "x int, n int")
    one, many = (df.transform(_numbered, "x", w).orderBy("x").collect() for w in (None, 20))
    assert [r["cell"] for r in one] == [r["cell"] for r in many] == list(range(1, 51))
    base = _numbered(df, "x", 20, "n").orderBy("x").collect()
    assert [r["base"] for r in base] == list(np.cumsum([0] + [k % 3 + 1 for k in range(49)]))


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], list(range(1001)), [5.0] * 400 + [1.0, 9.0], [float(x) for x in np.random.default_rng(1).normal(size=777)]])
def test_median_in_passes(spark, values):
    df = stored(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"))
    got, n = exact_median(df, "x", at_once=50)
    assert n == len(values) and (got is None) == (not values) and (not values or got == pytest.approx(float(np.median(values))))


def test_stored_tables_and_cuts_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "x int, y string, z array<double>")
    assert sorted(map(tuple, stored(df).collect())) == sorted(map(tuple, cut(df).collect())) == sorted(map(tuple, df.collect()))
    assert stored(df.where("false")).count() == 0 and stored(df).schema == df.schema


def test_own_kinds_and_static_values(spark):
    vis = _vis(spark).withColumns({"tcell": F.lit(1), "fcell": F.lit(1)})
    cells = spark.createDataFrame([(1, 0.0)], "cell int, ref double")
    s = Solution(spark.createDataFrame([("Twist", 1, 1, 1, 1, 0.3), ("Twist", 1, 2, 1, 1, 0.3)], "kind string, p int, i int, tcell int, fcell int, value double"), cells, cells)
    with pytest.raises(ValueError):
        calibrate(vis, s, ["Twist"])
    gains.register_kind("Twist", True, "", lambda value, t, nu, t_ref, nu_ref: value * 2)
    try:
        phase = calibrate(vis.where("p = 1 AND q = 2").withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), s, ["Twist"]).select(F.atan2("im", "re")).distinct().collect()
        assert [round(r[0], 9) for r in phase] == [-0.6] and s.kinds() == ["Twist"]
        back = calibrate(corrupt(vis, s, ["Twist"]), s, ["Twist"])
        assert back.agg(F.max(F.abs(F.col("im")))).first()[0] == pytest.approx(vis.agg(F.max(F.abs(F.col("im")))).first()[0])
    finally:
        del gains.KINDS["Twist"]
    tcells = spark.range(1, 10_001).selectExpr("CAST(id AS INT) cell", "id * 1D ref")
    many = install_static(Solution(s.components.where("false"), tcells, cells), spark.createDataFrame([("Delay", 1, 1, 1, 2.0)], "kind string, p int, i int, fcell int, value double"))
    assert many.components.agg(F.count("*"), F.countDistinct("tcell"), F.sum("value")).first() == (10_000, 10_000, 20_000.0)
    assert install_static(Solution(s.components, tcells.where("false"), cells), many.components.drop("tcell")).components.count() == 2


def test_wide_bandpass_is_the_same_solve(spark):
    rng = np.random.default_rng(6)
    rows = []
    for h in range(5):
        for p, q in ((1, 2), (1, 3), (2, 3)):
            for k in range(1, 5):
                for t in (1, 2):
                    z = np.exp(1j * (0.3 * np.sin(p * k) - 0.3 * np.sin(q * k) + h)) * (1 + 0.05 * k * p) + 0.01 * (rng.normal() + 1j * rng.normal())
                    w = float(rng.uniform(1, 2))
                    rows.append((1, p, q, 1, 1, h, 1 if k < 3 else 2, t, k, float(w * z.real), float(w * z.imag), w))
    sums = spark.createDataFrame(rows, "source int, p int, q int, i int, j int, hcell int, acell int, tcell int, k int, sre double, sim double, sw double")
    key = ["tcell", "p", "i", "k"]
    a, b = (f(sums, 7, 1e-3, (1, 1)).toPandas().sort_values(key, ignore_index=True) for f in (solve_bandpass, solve_bandpass_wide))
    assert len(a) == len(b) == 2 * 3 * 4 and (a[key] == b[key]).all(axis=None)
    assert np.allclose(a[["phase", "log_amp"]], b[["phase", "log_amp"]], atol=1e-10) and a["phase"].abs().max() > 0.1
    assert solve_bandpass_wide(sums.where("false"), 3, 1e-3).count() == 0
    with pytest.raises(ValueError):
        solve_bandpass_wide(sums, 1, 1e-3, (9, 1))


def test_strategies(spark):
    times = spark.createDataFrame([(float(t), "s") for t in (0, 10, 500, 510, 2000)], "t double, source string")
    assert [r["scan"] for r in gap_scans(100.0)(times).orderBy("t").collect()] == [1, 1, 2, 2, 3]
    assert [r["scan"] for r in listed_scans([5.0, 600.0])(times).orderBy("t").collect()] == [0, 1, 1, 1, 2]
    rows = listed_scans([5.0, 600.0])(times)
    STRATEGIES["own"] = lambda x: whole(x.where("scan > 0"))
    try:
        p = time_mode(rows, "own")
        assert p.n_cells() == 1 and p.supports().first()["lo"] == 10.0 and p.references().first()["ref"] == 1005.0
    finally:
        del STRATEGIES["own"]
    assert by_scan(rows).n_cells() == 3


def test_seeds_and_mirrored_models(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 400)) * 0.1
    z = np.exp(2j * np.pi * (u * 0 + v * 0)) + 0.6 * np.exp(2j * np.pi * (u * 5 + v * 4))
    of = lambda noise: spark.createDataFrame(pd.DataFrame({"source": 1, "u": u, "v": v, "re": z.real + rng.normal(size=400) * noise, "im": z.imag + rng.normal(size=400) * noise, "w": 1e4}).astype({"source": "int32"}))
    settings = {"grid": Grid(32, 1.0), "gain": 0.2, "niter": 2000, "sigmas": 3.0, "weight_scale": 1.0}
    images = image_by_receptor({1: of(0.5), 2: of(0.0), 3: of(0.0).where("false")}, **settings).cache()
    assert {r["slot"] for r in images.select("slot").collect()} == {1, 2}
    seed = best_seed(images).collect()
    assert len(seed) == 1 and seed[0]["slot"] == 2 and len(seed[0]["components"]) > 1
    models = spark.sql("SELECT 1 source, array(struct(1D flux, 0D x, 0D y), struct(0.6D flux, 5D x, 4D y)) components UNION ALL SELECT 9, array(struct(1D flux, 0D x, 0D y))")
    (c,) = beam_matched_correlation(images.where("slot = 2"), models).collect()
    assert c["r"] > 0.9 > 0.5 > c["r_rotated"] and c["n"] < 32 * 32


def test_injections_and_split_reports(spark, observables):  # noqa: F811
    f = whatif.injection_families(observables.withColumn("tau_iono", F.lit(1e-11)), reps=2, modes=50).cache()
    n = observables.count()
    assert {(r["family"], r["count"]) for r in f.groupBy("family").count().collect()} == {("diurnal", 2 * n), ("semidiurnal", 2 * n), ("iono_scale", 2 * n), ("zwd_turbulence", 2 * n)}
    again = whatif.injection_families(observables.withColumn("tau_iono", F.lit(1e-11)).repartition(5), reps=2, modes=50)
    assert f.exceptAll(again).count() == 0 and f.select("label").distinct().count() == 8
    size = {r["family"]: r["s"] for r in f.groupBy("family").agg(F.sqrt(F.avg(F.col("injected") ** 2)).alias("s")).collect()}
    assert 5e-12 < size["diurnal"] < 30e-12 and size["iono_scale"] == pytest.approx(2e-12) and 5e-12 < size["zwd_turbulence"] < 90e-12
    assert whatif.injection_families(observables.where("false")).count() == 0
    none = f.where("label = 'diurnal#1'").withColumn("injected", F.lit(0.0))
    t = whatif.split_transfer(observables, SPEC, {"none": [none]})
    assert set(t["split"]) == {"time", "scan", "slot"} and t["change_mas"].max() == pytest.approx(0, abs=1e-9) and np.allclose(t["base_mas"], t["injected_mas"])
    g = whatif.split_geometry(observables, "slot = 1").toPandas()
    thin = g[g.half.isna()].set_index("source")
    assert len(thin) == 4 and all(thin.loc[s, "n_obs"] == x.n_obs.min() for s, x in g[g.half.notna()].groupby("source"))
    a = whatif.application_scan({"as is": observables, "shifted": observables.withColumn("tau_residual", F.col("tau_residual") + F.col("dtau_dra") * 1e-9)}, SPEC, lambda fit: {"sources": len(fit.layout.sources)})
    assert list(a["arm"]) == ["as is", "shifted"] and set(a["sources"]) == {4} and a["slot_mas"].notna().all()


def test_context_is_assembled(spark, tmp_path):
    geometry = spark.createDataFrame([("A", 4075539.9, 931735.3, 4801629.4, 1.0, [0.0] * 33, [0.0] * 33), ("B", -1324009.0, -5332181.0, 3231962.0, 0.0, [0.0] * 33, [0.0] * 33)], "code string, x double, y double, z double, axis_offset double, amplitude array<double>, phase array<double>")
    eop = spark.createDataFrame([(60000.0 + k, 0.1, 0.3, 0.01 * k, 0.0, 0.0) for k in range(20)], "mjd double, xp double, yp double, ut1_utc double, dx double, dy double")
    (tmp_path / "a.i").write_text(_tec(1, (0, 23), 100))
    tec = readers.read_tec_maps(spark, str(tmp_path / "a.i"))
    pressure = spark.createDataFrame([(7, 10.0, 990.0), (7, 0.0, 1000.0)], "antenna_no int, t double, pressure double")
    channels = spark.createDataFrame([(k, 8.4e9 + k * 1e7) for k in range(4)], "chan int, nu double")
    c = sr.assemble_context(geometry, eop, pressure, {"x": tec}, 60008.0, channels, "x", 1.5, {"A": 7, "B": 8})
    assert set(c.stations) == {"A", "B"} and c.stations["A"].loading_amplitude.shape == (3, 11) and c.pressure["A"][1].tolist() == [1000.0, 990.0] and "B" not in c.pressure
    assert c.orientation(np.array([60008.5]))["ut1_utc"] == pytest.approx(0.085) and 8.4e9 < c.nu_eff < 8.44e9 and c.tec["x"].tec.shape[0] == 2 and c.doy == 64
    with pytest.raises(ValueError):
        sr.assemble_context(geometry, eop, None, {"x": tec}, 60008.0, channels, "y", 1.5)
    with pytest.raises(ValueError):
        sr.assemble_context(geometry, eop, None, {}, 61000.0, channels, "", 1.5)


def test_outside_models_and_their_images(spark, tmp_path):
    (tmp_path / "s1_e.mod").write_text("1.0v 0.0v 0.0v\n0.5 2.0 90.0\n")
    for name, date in (("s1", "2024-01-01"), ("s2", "2024-06-01")):
        (tmp_path / f"{name}_e.fits").write_bytes(fits.image_bytes(np.zeros((4, 4)), fits.image_cards(name, 4, 0.1, 1.0, 2.0, (1.0, 1.0, 0.0), date, [])))
    wanted = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s1",)], "source string")
    models, census = readers.external_models(spark, f"file://{tmp_path}", wanted)
    got = {r["source"]: r for r in census.collect()}
    assert models.count() == 2 and {s: r["n_components"] for s, r in got.items()} == {"s1": 2, "s2": 0, "s3": 0}
    assert got["s1"]["naxis"] == 4 and got["s3"]["image_sha256"] is None and len(got["s2"]["image_sha256"]) == 64 and got["s2"]["sha256"] is None
    assert [r["source"] for r in readers.wrong_dates(census, "2024-01-02").collect()] == ["s2"]
    own = spark.sql("SELECT 's1' source, array(struct(1D flux, 0D x, 0D y)) components")
    config = SessionConfig("n", "v", "A", "w", members=(PointSource(), ExternalModels("ext", "{src}.mod"), OwnImaging(variants=(("fine", {}),))))
    sets = sr.expanded_models(config, {"ext": own}, {"own": own, "own-fine": own})
    assert {r["model_set"] for r in sets.collect()} == {"ext", "own", "own-fine"}
    with pytest.raises(ValueError):
        sr.expanded_models(config, {}, {"own": own, "own-fine": own})


def test_simulation_with_callables(spark):
    channels = spark.createDataFrame([(1, 8.4e9, 1), (2, 8.5e9, 1)], "chan int, nu double, if_id int")
    v = readers.simulate(spark, 3, [0.0, 1.0], channels, [2])
    w = readers.with_coherency(v, lambda x: x["chan"] * 2.0, lambda x: (x["p"] * 1.0, x["q"] * 1.0), lambda x: (F.cos(x["u"]), F.sin(x["v"])))
    r = w.where("p = 1 AND q = 3 AND i = 1 AND j = 1 AND chan = 2 AND t = 0").first()
    assert (r["u"], r["v"], r["w"]) == (1.0, 3.0, 4.0) and r["re"] == pytest.approx(math.cos(1)) and r["im"] == pytest.approx(math.sin(3))
    assert w.where("p = 2 AND i = 2 AND w > 0").count() == 0 and readers.with_coherency(v).exceptAll(v).count() == 0


def test_views_and_metadata(spark):
    assert ui.enabled_apply(["a", "b", "c"], {"b": False}) == ["a", "c"]
    pairs = spark.createDataFrame([(1, 2), (3, 1)], "p int, q int")
    assert ui.resolve_pair(pairs, 1, 2) == (1, 2, False) and ui.resolve_pair(pairs, 1, 3) == (3, 1, True) and ui.resolve_pair(pairs, 2, 3) is None
    step = {r["scan"]: (r["step"], r["n"]) for r in ui.cadence(spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 2.0), (1, 4.0), (1, 9.0), (2, 5.0)], "scan int, t double")).collect()}
    assert step == {1: (2.0, 4), 2: (None, 1)}
    positions = spark.createDataFrame([("s1", "point", "point", 1.0, 2.0, 0.1, 0.2), ("s2", "point", "point", 0.0, 0.0, 0.1, 0.2)], "source string, model_set string, kind string, dra_mas double, ddec_mas double, sigma_ra_mas double, sigma_dec_mas double")
    sources = spark.createDataFrame([("s1", "J1", 1.0, 0.5)], "source string, jname string, ra double, dec double")
    facts = spark.createDataFrame([("s1", "point", 3, 7.0)], "source string, model_set string, n_accepted int, wrms_ps double")
    model = {"s": 1.0, "floor_ra_mas": 0.0, "floor_dec_mas": 0.0}
    rows = sr.catalogue_rows(positions, sources, facts, model).orderBy("source").collect()
    assert rows[0].__fields__ == sr.CATALOGUE and len(sr.CATALOGUE) == 49
    assert (rows[0]["n_accepted"], rows[1]["n_accepted"], rows[1]["jname"]) == (3, 0, "") and math.isnan(rows[1]["ra_deg"]) and math.isnan(rows[0]["peak_ra_deg"])
    assert rows[0]["dec_deg"] == pytest.approx(math.degrees(0.5 + 2 * dm.MAS))
    session = sr.Session(SessionConfig("n", "v", "A", "w"), sources, spark.createDataFrame([(k, 8.4e9 + k * 1e7) for k in range(4)], "chan int, nu double"), None, None, None, {})
    floors = spark.createDataFrame([("point", 0.2, 1), (None, 0.3, 1)], "model_set string, floor double, n int")
    meta = sr.catalogue_metadata(session, sr.catalogue_rows(positions, sources, facts, model), model, [0.1, 0.2, 0.3], floors, {"point": {"kind": "point"}}, {"epoch": 2024.0})
    assert (meta["n_rows"], meta["n_sources"], meta["ensemble_floor_mas"], meta["model_sets"]["point"]["ensemble_floor_mas"], meta["epoch"]) == (2, 2, 0.3, 0.2, 2024.0)


def test_captured_phases_and_thin_wrappers(spark, observables):  # noqa: F811
    cells, fcells = spark.createDataFrame([(1, 0.0)], "cell int, ref double"), spark.createDataFrame([(1, 8.4e9)], "cell int, ref double")
    kind = "kind string, p int, i int, tcell int, fcell int, value double"
    s = Solution(spark.createDataFrame([("Delay", 1, 1, 1, 1, 1e-9), ("PhaseOffset", 1, 1, 1, 1, 0.5), ("Rate", 1, 1, 1, 1, 9.0)], kind), cells, fcells)
    channels = spark.createDataFrame([(1, 8.4e9), (2, 8.5e9)], "chan int, nu double")
    got = {r["chan"]: r["phase"] for r in sr.captured_applied_phase(s, channels, channels.select("chan", F.lit(1).alias("fcell"))).collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(0.5 + 2 * math.pi * 0.1)}
    session = sr.Session(SessionConfig("n", "v", "AA", "w", fit=SPEC), observables, None, None, None, None, {})
    f = sr.solve(session, observables)
    sets = whatif.register({"point": observables}, SPEC)
    assert np.allclose(f.x, sets["point"]["fit"].x) and whatif.fit_baselines(sets).agg(F.sum("n")).first()[0] == whatif.selected_counts(sets).agg(F.sum("n_accepted")).first()[0] == observables.count()


def test_states_of_the_instrument(spark):
    vis = _vis(spark)
    cells = spark.createDataFrame([(1, 0.0)], "cell int, ref double")
    zero = Solution(spark.createDataFrame([], "kind string, p int, i int, tcell int, fcell int, value double"), cells, cells)
    session = sr.Session(SessionConfig("n", "v", "A", "w"), vis, None, None, None, None, {})
    align = spark.createDataFrame([("Delay", 1, 1, 1, 1e-9)], "kind string, p int, i int, fcell int, value double")
    gain = spark.createDataFrame([(1, 1, 1, 1, 0.5)], "p int, i int, tcell int, fcell int, value double")
    states = sr.instrumental(session, zero, None, align, gain)
    assert list(states) == ["none", "tones", "alignment", "gains"] and [s.components.count() for s in states.values()] == [0, 0, 1, 2]


def test_reports_hold_whole_tables(spark, tmp_path):
    df = spark.range(2500).selectExpr("id")
    assert len(sinks.write_report(str(tmp_path), "t", {"a": 1}, {"rows": df}).read_text().splitlines()) > 2500
    with pytest.raises(ValueError):
        sinks.write_report(str(tmp_path), "t", {}, {"rows": df}, 1000)
