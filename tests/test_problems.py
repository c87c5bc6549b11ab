"""The general training-data operators against brute force, and their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.operators.chow_liu import Tree, mutual_information, pair_counts
from vislake.operators.impute import fill_readings
from vislake.operators.interval_runs import runs_and_gaps, united
from vislake.plans.intervals import covers
from vislake.operators.references import Child, Registry, cascade, direct_orphans, text_key
from vislake.operators.regular_grid import to_grid
from vislake.operators.timejoin import bracketing, first_cell, largest_overlap, last_valid, merged_intervals, overlapping, unflagged

# --- 1: regular grid -------------------------------------------------------------------------------------------------

GRID = "s string, b int, t bigint, v double, t0 bigint, stop bigint, g bigint"


def _grid(spark, rows, **kw):
    return {(r["s"], r["b"], r["period_start_us"]): r for r in to_grid(spark.createDataFrame(rows, GRID), ["s", "b"], "t", "v", "t0", "stop", "g", **kw).collect()}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_grid_matches_brute_force_whatever_the_block(spark, block):
    rng = random.Random(1)
    rows = []
    for s in ("a", "b", None):
        for b in (1, None):
            for _ in range(rng.randrange(1, 9)):
                rows.append((s, b, rng.randrange(-20, 320), float(rng.randrange(9)), 100, 300, 10))
    got = _grid(spark, rows, block=block, max_gap=2)
    occupied = defaultdict(lambda: defaultdict(list))
    for s, b, t, v, t0, stop, g in rows:
        if t0 <= t < stop:
            occupied[s, b][(t - t0) // g].append(v)
    want = {(s, b, 100 + 10 * k) for s, b in occupied for k in range(20)}
    assert set(got) == want
    for (s, b), ks in occupied.items():
        order = sorted(ks)
        for k in range(20):
            r = got[s, b, 100 + 10 * k]
            if k in ks:
                assert (r["mark"], r["n_readings"]) == ("measured", len(ks[k])) and r["value"] == pytest.approx(np.mean(ks[k]))
                continue
            before, after = [x for x in order if x < k], [x for x in order if x > k]
            if before and after:
                a, c = before[-1], after[0]
                assert r["gap_periods"] == c - a - 1
                if c - a - 1 <= 2:
                    assert r["mark"] == "interpolated"
                    assert r["value"] == pytest.approx(np.mean(ks[a]) + (np.mean(ks[c]) - np.mean(ks[a])) * (k - a) / (c - a))
                else:
                    assert r["mark"] == "gap" and r["value"] is None
            elif after:
                near = after[0] - k <= 2
                assert r["mark"] == ("held" if near else "before_first") and (r["value"] is None) == (not near)
            else:
                near = k - before[-1] <= 2
                assert r["mark"] == ("held" if near else "after_last") and (r["value"] is None) == (not near)


def test_grid_leaves_out_what_is_no_reading(spark):
    bad = [("a", 1, 110, float("nan"), 100, 300, 10), ("a", 1, 110, None, 100, 300, 10), ("a", 1, None, 1.0, 100, 300, 10), ("a", 1, 300, 1.0, 100, 300, 10), ("a", 1, 110, float("inf"), 100, 300, 10), ("a", 1, 110, 1.0, 100, 300, 0)]
    assert _grid(spark, bad) == {}
    assert _grid(spark, []) == {}
    ties = _grid(spark, [("a", 1, 110, 1.0, 100, 130, 10)] * 3)
    assert len(ties) == 3 and ties["a", 1, 110]["n_readings"] == 3


def test_grid_ignores_extra_columns_with_its_own_names(spark):
    df = spark.createDataFrame([("a", 1, 110, 2.0, 100, 130, 10)], GRID).withColumns({c: F.lit("x") for c in ("k", "n", "cnt", "block", "key0", "mark", "value")})
    assert to_grid(df, ["s", "b"], "t", "v", "t0", "stop", "g").count() == 3


def test_long_gaps_are_cut_into_blocks(spark):
    df = spark.createDataFrame([("a", 1, 5, 2.0, 0, 1_000_000, 10), ("a", 1, 999_995, 4.0, 0, 1_000_000, 10)], GRID)
    got = to_grid(df, ["s", "b"], "t", "v", "t0", "stop", "g", block=64).groupBy("mark").agg(F.count("*").alias("n"), F.countDistinct("period_start_us").alias("d")).collect()
    assert {(r["mark"], r["n"], r["d"]) for r in got} == {("measured", 2, 2), ("gap", 99_998, 99_998)}


# --- 2: filling ------------------------------------------------------------------------------------------------------


def _tables(spark, rows):
    st = spark.createDataFrame(rows, "st_id bigint, session string, rec_id bigint, time timestamp_ntz, antenna_no int, band int, tsys_1 double, tsys_2 double")
    sessions = spark.sql("SELECT 's1' session, timestamp_ntz'2024-01-01 00:00:00' time0, timestamp_ntz'2024-01-01 01:00:00' stop_at, 30 grid_s, 20D match_tol_s, 500D tsys_ceiling")
    antennas = spark.sql("SELECT * FROM VALUES (1, 'A'), (2, 'B') AS t(antenna_no, name)")
    return st, sessions, antennas


def _t(minute):
    return pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=minute).to_pytimedelta()


def test_filling_takes_the_record_and_the_group(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "s1", 10, _t(1), 1, 1, 30.0, 31.0), (2, "s1", 10, _t(1), None, 2, 40.0, 41.0), (3, "s1", 11, _t(2), 1, 1, nan, 31.0), (4, "s1", 12, _t(3), 0, 1, 33.0, None),
            (5, "s1", 13, _t(4), 9, 1, 50.0, 50.0), (6, "s1", 13, _t(4), 2, 2, 60.0, 61.0), (7, "s1", 13, _t(4), None, 2, inf, 61.0), (8, "s1", 14, _t(5), 1, 2, -1.0, 41.0),
            (9, "s1", 15, _t(6), 2, 3, None, 41.0), (10, "s1", None, _t(6), None, 1, 501.0, nan), (11, "s1", 10, _t(1), 1, None, None, None)]
    got = {r["st_id"]: r for r in fill_readings(*_tables(spark, rows)).collect()}
    assert len(got) == 11
    assert (got[2]["antenna_no"], got[2]["antenna_mark"]) == (1, "filled")
    assert (got[7]["antenna_no"], got[7]["antenna_mark"]) == (2, "filled")  # found in antennas goes before the larger 9
    assert got[4]["antenna_no"] is None and got[4]["antenna_mark"] == "absent" and got[10]["antenna_mark"] == "absent"
    assert got[3]["tsys_mark"] == "filled" and abs(got[3]["tsys_1"] - 30) < 1
    assert got[7]["tsys_mark"] == "filled" and got[8]["tsys_mark"] == "filled"  # row 2 was given antenna 1: band 2 has a reading
    assert got[9]["tsys_mark"] == "absent" and got[9]["tsys_1"] is None and got[10]["tsys_mark"] == "absent" and got[11]["tsys_mark"] == "absent"
    assert got[1]["tsys_mark"] == "recorded" and got[1]["tsys_1"] == 30.0


def test_filling_an_empty_table(spark):
    assert fill_readings(*_tables(spark, [])).count() == 0


def test_filled_readings_are_closer_than_the_global_median(spark):
    rng = np.random.default_rng(3)
    rows, hidden = [], {}
    for k in range(900):
        ant, band = int(rng.integers(1, 3)), int(rng.integers(1, 4))
        level = {1: 30.0, 2: 90.0}[ant] * (1 + 0.3 * band)
        value = float(level * np.exp(rng.normal() * 0.05))
        if k % 10 == 0:
            hidden[k] = value
        rows.append((k, "s1", k, _t(k / 20), ant, band, None if k % 10 == 0 else value, float(value * np.exp(rng.normal() * 0.03))))
    got = {r["st_id"]: r for r in fill_readings(*_tables(spark, rows)).where("tsys_mark = 'filled'").collect()}
    assert set(got) == set(hidden)
    error = np.mean([abs(np.log(got[k]["tsys_1"] / v)) for k, v in hidden.items()])
    median = np.median([r[6] for r in rows if r[6]])
    assert error < 0.06 < 0.3 < np.mean([abs(np.log(median / v)) for v in hidden.values()])


def test_filling_is_the_same_model_at_any_number_of_antennas(spark):
    rng = np.random.default_rng(5)
    # One group's readings are of two kinds that only the antenna tells apart from the time and the second reading.
    rows = [(k, f"s{k % 2 + 1}", k, _t(k / 20), k % 3 + 1, 1, None if k % 10 == 0 else float({0: 30, 1: 90, 2: 200}[k % 3] * np.exp(rng.normal() * 0.3)), None) for k in range(300)]
    st, sessions, antennas = _tables(spark, rows)

    def filled(n: int) -> list:
        more = antennas.unionByName(spark.range(1001, 1001 + n - antennas.count()).select(F.col("id").cast("int").alias("antenna_no")), allowMissingColumns=True)
        return sorted(tuple(x) for x in fill_readings(st, sessions, more).select("st_id", "antenna_no", "tsys_1", "tsys_mark", "tsys_probability").where("tsys_mark = 'filled'").collect())

    assert filled(500) == filled(501) != []


def test_tree_posterior_equals_enumeration(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, 4000)
    b = (a + (rng.random(4000) < 0.2)) % 3
    c = (b + 2 * (rng.random(4000) < 0.3)) % 3
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c}).astype("int32"))
    counts = pair_counts(df, {"a": 3, "b": 3, "c": 3})
    assert counts["a", "b"].sum() == 4000 and mutual_information(counts["a", "b"]) > mutual_information(counts["a", "c"])
    tree = Tree.learn(df, {"a": 3, "b": 3, "c": 3})
    assert {frozenset(e[:2]) for e in tree.edges} == {frozenset("ab"), frozenset("bc")}
    ab = next(e[2] if e[0] == "a" else e[2].T for e in tree.edges if set(e[:2]) == {"a", "b"})
    bc = next(e[2] if e[0] == "b" else e[2].T for e in tree.edges if set(e[:2]) == {"b", "c"})
    joint = ab[:, :, None] * (bc / bc.sum(1, keepdims=True))[None]
    got = tree.posterior("a", {"b": np.array([-1, 2]), "c": np.array([1, 0])})
    assert np.allclose(got[0], joint[:, :, 1].sum(1) / joint[:, :, 1].sum(), atol=1e-3)
    assert np.allclose(got[1], joint[:, 2, 0] / joint[:, 2, 0].sum(), atol=1e-3)
    assert pair_counts(df.where("false"), {"a": 3, "b": 3, "c": 3})["a", "b"].sum() == 0


# --- 3: intervals ----------------------------------------------------------------------------------------------------


def _brute(rows):
    out, by = [], defaultdict(list)
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            by[k].append((s, e))
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged] + [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(-300, 300), s + rng.choice([0, 0, 1, 5, 10, 200])) for _ in range(rng.randrange(1, 120))]
    rows += rows[:5] + [("a", 5, None), ("a", None, 5), ("b", 9, 3)]
    df = spark.createDataFrame(rows, "k string, start_us bigint, end_us bigint").withColumn("shard", F.lit("x")).withColumn("starts", F.lit(1))
    got = sorted(map(tuple, runs_and_gaps(df, ["k"], shard_us=37).collect()), key=str)
    assert got == _brute(rows)


def test_intervals_of_nothing_and_of_one_long_cover(spark):
    empty = spark.createDataFrame([], "k string, start_us bigint, end_us bigint")
    assert runs_and_gaps(empty, ["k"]).count() == 0
    long = spark.createDataFrame([("a", 0, 10**17), ("a", 5, 6), ("a", 10**17 + 1, 10**17 + 2)], "k string, start_us bigint, end_us bigint")
    assert sorted(map(tuple, runs_and_gaps(long, ["k"]).collect())) == [("a", "gap", 10**17, 10**17 + 1), ("a", "period", 0, 10**17), ("a", "period", 10**17 + 1, 10**17 + 2)]


def test_united_keeps_groups_apart():
    g, s, e = united(np.array([0, 0, 1, 1]), np.array([0, 5, 1, 9]), np.array([100, 6, 2, 9]))
    assert (g.tolist(), s.tolist(), e.tolist()) == ([0, 1, 1], [0, 1, 9], [100, 2, 9])


# --- 4: references ---------------------------------------------------------------------------------------------------


def _registry(spark):
    rows = [("Aa", "x1", "2020-01-01", "2021-01-01"), ("Aa", "x1", "2022-01-01", None), ("Bb", None, "2023-01-01", None)]
    df = spark.createDataFrame(rows, "name string, alias string, added string, removed string").selectExpr("name", "alias", "cast(added as timestamp_ntz) added_at", "cast(removed as timestamp_ntz) removed_at", "1 valid", "2 ref_key")
    return Registry(df, [text_key(F.col("name")), text_key(F.col("alias"))])


def _child(spark, rows, parents=None):
    df = spark.createDataFrame(rows, "id bigint, key string, t string").selectExpr("id", "key", "cast(t as timestamp_ntz) time", "'z' valid", "'z' reason")
    return Child(df, "id", "time", "r", text_key(F.col("key")), parents or {})


def test_covers_longer_than_the_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01' time, cast(i as double) interval, 's' session, 1 antenna_no FROM values ('Infinity'), ('1e300'), ('NaN'), ('-1'), (NULL), ('2') AS v(i)")
    got = {(r["end_us"] - r["start_us"]) for r in covers(df, "x").collect()}
    assert got == {9 * 10**18, 2_000_000}
    assert [r["kind"] for r in runs_and_gaps(covers(df, "x"), ["tab", "session", "antenna_no"]).collect()] == ["period"]


def test_orphans_by_reason(spark):
    rows = [(1, "aa", "2020-06-01"), (2, " X1 ", "2021-06-01"), (3, "bb", "2022-01-01"), (4, "zz", "2022-01-01"), (5, None, "2022-01-01"), (6, "  ", "2022-01-01"), (7, "aa", "2021-01-01"), (8, "aa", "2022-01-01"), (9, "zz", None), (10, "aa", None), (4, "zz", "2022-01-01")]
    got = sorted((r["row_id"], r["reason"]) for r in direct_orphans(_child(spark, rows), _registry(spark)).collect())
    assert got == [(2, "deleted"), (3, "later"), (4, "missing"), (4, "missing"), (7, "deleted"), (9, "missing")]


def test_cascade_runs_to_a_fixpoint_over_a_cycle(spark):
    a = _child(spark, [(1, "zz", "2022-01-01"), (2, "aa", "2022-06-01")])
    b = Child(spark.createDataFrame([(10, 1, 11), (11, 2, 10), (12, 2, 11), (13, None, 99)], "id bigint, a_id bigint, next bigint").withColumn("time", F.expr("timestamp_ntz'2022-01-01'")), "id", "time", parents={"a": (["a_id"], ["id"]), "b": (["next"], ["id"])})
    got = {(r["tab"], r["row_id"]): (r["kind"], r["depth"]) for r in cascade({"a": a, "b": b}, {"r": _registry(spark)}).collect()}
    assert got == {("a", 1): ("direct", 0), ("b", 10): ("inherited", 1), ("b", 11): ("inherited", 2), ("b", 12): ("inherited", 3)}


def test_cascade_of_empty_tables(spark):
    assert cascade({"a": _child(spark, [])}, {"r": _registry(spark)}).count() == 0


# --- joins on time ---------------------------------------------------------------------------------------------------


def test_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    left = [(k, rng.choice("ab"), lo := rng.uniform(0, 100), lo + rng.choice([0, 3, 40])) for k in range(60)]
    right = [(c, rng.choice("ab"), lo := rng.uniform(0, 100), lo + rng.choice([0, 5, 30])) for c in range(40)]
    a = spark.createDataFrame(left, "row_key int, g string, lo double, hi double").union(spark.sql("SELECT 99, 'a', double('nan'), 1D"))
    b = spark.createDataFrame(right, "cell int, g string, r_lo double, r_hi double")
    want = sorted((k, c) for k, g, lo, hi in left for c, h, x, y in right if g == h and lo <= y and x <= hi)
    for width in (1.0, 7.0, 1000.0):
        assert sorted((r["row_key"], r["cell"]) for r in overlapping(a, b, ["g"], width).collect()) == want
    assert {r["row_key"] for r in overlapping(a, b, ["g"], 7.0, "left_anti").collect()} == ({k for k, *_ in left} | {99}) - {k for k, _ in want}
    best = {r["row_key"]: r["cell"] for r in largest_overlap(a, b, ["g"], 7.0).collect()}
    for k, g, lo, hi in left:
        c = [(-(min(hi, y) - max(lo, x)), c) for c, h, x, y in right if g == h and lo <= y and x <= hi and (min(hi, y) > max(lo, x) or lo == hi)]
        assert best.get(k) == (min(c)[1] if c else None)


def test_flags_asof_and_bracketing(spark):
    rows = spark.createDataFrame([(1, "A", "B", 0.0, 1.0), (2, "A", "B", 5.0, 6.0), (3, "C", "B", 9.0, 9.5)], "row_key int, a1 string, a2 string, lo double, hi double")
    flags = spark.createDataFrame([("B", 6.0, 7.0), ("B", 6.5, 8.0), ("A", 2.0, 4.9)], "antenna string, r_lo double, r_hi double")
    assert {r["row_key"] for r in unflagged(rows, flags, 2.0).collect()} == {1, 3}
    assert merged_intervals(flags, ["antenna"]).count() == 2
    q = spark.createDataFrame([("k", 5.0, 1), ("k", 0.5, 2), ("k", 20.0, 3), ("m", 1.0, 4)], "k string, t double, row_key int")
    rec = spark.createDataFrame([("k", 1.0, 100.0, "a"), ("k", 4.0, 3.0, "b")], "k string, start double, duration double, v string")
    assert {r["row_key"]: r["v"] for r in last_valid(q, rec, ["k"], ["v"]).collect()} == {1: "b", 2: None, 3: None, 4: None}
    series = spark.createDataFrame([("k", 1.0, 10.0), ("k", 9.0, 26.0)], "k string, s double, x double")
    assert {r["row_key"]: r["x"] for r in bracketing(q, series, ["k"]).collect()} == {1: 18.0, 2: 10.0, 3: 26.0, 4: None}
    cells = spark.createDataFrame([("k", 2, 0.0, 6.0), ("k", 1, 4.0, 9.0)], "k string, cell int, r_lo double, r_hi double")
    assert {r["row_key"]: r["cell"] for r in first_cell(q, cells, ["k"], 3.0).collect()} == {1: 1, 2: 2}


def test_scans_and_asof_do_not_depend_on_shards(spark):
    from vislake.operators.partition import scans_by_gap

    rng = random.Random(6)
    rows = sorted({(float(rng.randrange(400)), rng.choice(["a", "a", None])) for _ in range(90)}, key=lambda x: (x[0], x[1] or ""))
    df = spark.createDataFrame(rows + [(None, "a")], "t double, source string")
    for keys in ([], ["source"]):
        got = [{(r["t"], r["source"]): r["scan"] for r in scans_by_gap(df, 7.0, keys, shard).collect()} for shard in (1.0, 50.0, 1e6)]
        assert got[0] == got[1] == got[2] and set(got[0]) == set(rows) and min(got[0].values()) == 1
    times = sorted({t for t, _ in rows})
    one = {r["t"]: r["scan"] for r in scans_by_gap(spark.createDataFrame([(t,) for t in times], "t double"), 7.0, shard=13.0).collect()}
    n, want = 0, {}
    for k, t in enumerate(times):
        n += k == 0 or t - times[k - 1] > 7.0
        want[t] = n
    assert one == want
    q = spark.createDataFrame([(rng.choice("ab"), rng.uniform(-50, 500), k) for k in range(80)], "k string, t double, row_key int")
    s = spark.createDataFrame([(rng.choice("ab"), float(rng.randrange(0, 400, 5)), float(k)) for k in range(20)], "k string, s double, x double").groupBy("k", "s").agg(F.max("x").alias("x"))
    rec = s.select("k", F.col("s").alias("start"), F.lit(60.0).alias("duration"), "x")
    for f in (lambda w: bracketing(q, s, ["k"], w), lambda w: last_valid(q, rec, ["k"], ["x"], w)):
        got = [sorted((r["row_key"], r["x"]) for r in f(w).select("row_key", F.coalesce("x", F.lit(-1.0)).alias("x")).collect()) for w in (3.0, 70.0, 1e9)]
        assert got[0] == got[1] == got[2] and len(got[0]) == 80
