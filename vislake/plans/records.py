"""Queries on instrument records and time joins over the session tables (S4, P3, P15, J3-J7, J14, G10, C13, C15, C16, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vislake.functions.complexmath import present
from vislake.operators.dimensions import dense_names, endpoints, quantiles
from vislake.operators.instrument import alignment_summary, derive_alignment, derive_alignment_by_setup, fallback_share, pcal_init, pick_tones, tone_health, tsys_init
from vislake.operators.timejoin import bracketing, first_cell, largest_overlap, last_valid, unflagged
from vislake.operators.tsys import has_antenna, usable
from vislake.plans.common import r
from vislake.session import bounded, finite, micros, table

#: Bucket of the time joins: ten minutes in microseconds.
BUCKET = 600_000_000
#: Scans hold single times in these tables; their supports reach this far to either side.
SIDE = 60_000_000


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "antennas").select("antenna_no", F.col("name").alias("antenna")).distinct()


def _node(session: str, antenna: str) -> Column:
    return F.concat_ws("|", F.col(session), F.col(antenna))


def _scan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, cell, r_lo, r_hi): the time support of every scan, a minute to either side of its rows."""
    t = micros(F.col("datetime"))
    return table(spark, sf_dir, "dataset").groupBy("session", F.col("scan").alias("cell")).agg((F.min(t) - SIDE).alias("r_lo"), (F.max(t) + SIDE).alias("r_hi"))


def _interval(df: DataFrame, *more: str) -> DataFrame:
    half = F.rint(F.col("interval") * 5e5).cast("bigint")
    good = F.coalesce(~F.isnan("interval") & (F.col("interval") >= 0) & (F.col("interval") < 1e9), F.lit(False))
    return df.where(good).select("session", "antenna_no", (micros(F.col("time")) - half).alias("lo"), (micros(F.col("time")) + half).alias("hi"), *more)


def src_s4_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").groupBy("session").agg(F.min(micros(F.col("datetime"))).alias("start_us"), F.max(micros(F.col("datetime"))).alias("stop_us"), F.count("*").alias("n_rows"))
    mid = F.timestamp_micros(F.floor((F.col("start_us") + F.col("stop_us")) / 2).cast("bigint"))
    year = F.year(mid)
    days = F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 366).otherwise(365)
    second = F.floor((F.col("start_us") + F.col("stop_us")) / 2).cast("bigint") - micros(F.date_trunc("year", mid))
    return d.select("session", "start_us", "stop_us", F.dayofyear(mid).alias("doy"), r(year + second / (days * 86400e6), 8).alias("decimal_year"), "n_rows")


def join_j3_unflagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _interval(table(spark, sf_dir, "system_temperature"), "tsys_1").where(F.col("tsys_1").isNull() | F.isnan("tsys_1") | (F.col("tsys_1") <= 0)).join(bounded(_names(spark, sf_dir)), "antenna_no")
    flags = st.select(_node("session", "antenna").alias("antenna"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    t = micros(F.col("datetime"))
    rows = table(spark, sf_dir, "dataset").select(F.col("vis_id").alias("row_key"), _node("session", "a1").alias("a1"), _node("session", "a2").alias("a2"), t.alias("lo"), (t + F.rint(F.col("int_time") * 1e6).cast("bigint")).alias("hi"))
    return unflagged(rows, flags, BUCKET).select(F.col("row_key").alias("vis_id"))


def join_j4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _interval(table(spark, sf_dir, "tones"), "tone_id").withColumnRenamed("tone_id", "row_key")
    return largest_overlap(records, _scan_cells(spark, sf_dir), ["session"], BUCKET).select(F.col("row_key").alias("tone_id"), "cell")


def join_g10_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "observables").select("session", F.col("obs_id").alias("row_key"), micros(F.col("datetime")).alias("t"))
    return first_cell(points, _scan_cells(spark, sf_dir), ["session"], BUCKET).select(F.col("row_key").alias("obs_id"), "cell")


def join_j5_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = table(spark, sf_dir, "gain_curve").where(has_antenna(F.col("antenna_no")) & (F.col("band") == 1)).select("session", "antenna_no", micros(F.col("time")).alias("start"), F.lit(3_000_000_000).alias("duration"), F.coalesce("dpfu_1", F.lit(-1.0)).alias("dpfu"))
    q = table(spark, sf_dir, "observables").join(bounded(_names(spark, sf_dir)), F.col("a1") == F.col("antenna")).select("session", "antenna_no", micros(F.col("datetime")).alias("t"), F.col("obs_id").alias("row_key"))
    return last_valid(q, curves, ["session", "antenna_no"], ["dpfu"], shard=86_400e6).select(F.col("row_key").alias("obs_id"), "antenna_no", "start", "dpfu")


def join_j5_last_valid_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for both ends and every band of the end's antenna; an end without curves comes out with a NULL band."""
    curves = table(spark, sf_dir, "gain_curve").where(has_antenna(F.col("antenna_no"))).select("session", "antenna_no", "band", micros(F.col("time")).alias("start"), F.lit(3_000_000_000).alias("duration"), F.coalesce("dpfu_1", F.lit(-1.0)).alias("dpfu"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"a{k}").alias("a")) for k in (1, 2)])).alias("x")
    q = table(spark, sf_dir, "observables").select("session", "obs_id", micros(F.col("datetime")).alias("t"), ends).join(bounded(_names(spark, sf_dir)), F.col("x.a") == F.col("antenna"))
    q = q.join(curves.select("session", "antenna_no", "band").distinct(), ["session", "antenna_no"], "left").select("session", "antenna_no", "band", "t", F.struct("obs_id", "x.side").alias("row_key"))
    return last_valid(q, curves, ["session", "antenna_no", "band"], ["dpfu"], shard=86_400e6).select("row_key.obs_id", "row_key.side", "antenna_no", "band", "start", "dpfu")


def join_j6_bracketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = has_antenna(F.col("antenna_no")) & finite(F.col("cable_cal"))
    series = table(spark, sf_dir, "tones").where(good).groupBy("session", "antenna_no", micros(F.col("time")).alias("s")).agg(F.avg("cable_cal").alias("x"))
    q = table(spark, sf_dir, "dataset").join(bounded(_names(spark, sf_dir)), F.col("a1") == F.col("antenna")).select("session", "antenna_no", micros(F.col("datetime")).alias("t"), F.col("vis_id").alias("row_key"))
    return bracketing(q, series, ["session", "antenna_no"], shard=86_400e6).select(F.col("row_key").alias("vis_id"), r(F.col("x") * 1e12, 6).alias("cable_ps"))


def join_j7_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of antennas and sources inside a session, and rows whose names are unknown."""
    return dense_names(table(spark, sf_dir, "dataset"), ["a1", "a2"], ["session"], _names(spark, sf_dir), "antenna", ["antenna_no"])


def join_j8_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the antennas' positions over every baseline (role-playing join)."""
    a = table(spark, sf_dir, "antennas").groupBy("name").agg(F.max("x_m").alias("x"), F.max("y_m").alias("y"), F.max("z_m").alias("z"))
    bl = table(spark, sf_dir, "dataset").select("a1", "a2").distinct()
    length = F.sqrt(sum((F.col(f"{c}2") - F.col(f"{c}1")) ** 2 for c in "xyz"))
    return endpoints(bl, a, "name", ["x", "y", "z"]).select("a1", "a2", *[r(F.col(f"{c}2") - F.col(f"{c}1"), 3).alias(f"d{c}") for c in "xyz"], r(length, 3).alias("length"))


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tones with the scan cell of their record; one row per (record, tone)."""
    t = table(spark, sf_dir, "tones").where(has_antenna(F.col("antenna_no")))
    cells = join_j4_cells(spark, sf_dir)
    return t.join(cells, "tone_id", "left").select("session", "antenna_no", F.col("cell").alias("tcell"), F.lit(1).alias("band"), "cable_cal", F.posexplode(F.arrays_zip("freq_1", "pcal_1_re", "pcal_1_im"))).select("session", "antenna_no", "tcell", "band", (F.col("pos") + 1).alias("tone"), F.col("col.freq_1").alias("freq"), F.col("col.pcal_1_re").cast("double").alias("re"), F.col("col.pcal_1_im").cast("double").alias("im"), F.col("cable_cal").alias("cable"))


def cal_c15_pcal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pcal_init(_tones(spark, sf_dir), ["session", "antenna_no"])
    return c.select("session", "antenna_no", "tcell", "band", r(F.col("delay") * 1e12, 3).alias("delay_ps"), r(F.cos("phase"), 5).alias("cos_phase"), r(F.sin("phase"), 5).alias("sin_phase"))


def sel_p15_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tones(spark, sf_dir).withColumn("band", F.col("session"))
    return tone_health(t, ["antenna_no"], 0.2).select(F.col("band").alias("session"), "tone", "healthy", r("worst", 8).alias("worst"))


def sel_p15_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tones(spark, sf_dir).withColumn("band", F.col("session"))
    return pick_tones(tone_health(t, ["antenna_no"], 0.2)).select(F.col("band").alias("session"), "low", "high")


def _tsys(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = ["session", "antenna_no", "band"]
    st = table(spark, sf_dir, "system_temperature")
    ceiling = bounded(table(spark, sf_dir, "sessions").select("session", "tsys_ceiling"))
    good = st.join(ceiling, "session").where(has_antenna(F.col("antenna_no")) & usable(F.col("tsys_1"), F.col("tsys_ceiling")))
    records = _interval(st, "st_id").withColumnRenamed("st_id", "row_key")
    cells = largest_overlap(records, _scan_cells(spark, sf_dir), ["session"], BUCKET)
    readings = good.join(cells, good["st_id"] == cells["row_key"], "left").select(*node, F.col("cell").alias("tcell"), F.col("tsys_1").alias("tsys"))
    curves = table(spark, sf_dir, "gain_curve").where(has_antenna(F.col("antenna_no")) & F.col("dpfu_1").isNotNull() & (F.col("y_typ_1") == 2)).groupBy(*node).agg(F.max(F.struct("time", "gc_id", "dpfu_1", "gain_1", "x_typ_1")).alias("c")).select(*node, F.col("c.dpfu_1").alias("dpfu"), F.col("c.gain_1").alias("gain"), F.col("c.x_typ_1").alias("x_typ"))
    obs = table(spark, sf_dir, "observables")
    el = obs.select("session", "scan", F.explode(F.array(F.struct(F.col("a1").alias("a"), F.col("el1").alias("el")), F.struct(F.col("a2").alias("a"), F.col("el2").alias("el")))).alias("x")).groupBy("session", "scan", "x.a").agg(F.max("x.el").alias("el"))
    el = el.join(bounded(_names(spark, sf_dir)), F.col("a") == F.col("antenna")).select("session", "antenna_no", F.col("scan").alias("tcell"), "el")
    wanted = el.join(curves.select(*node), ["session", "antenna_no"]).select(*node, "tcell", "el")
    return tsys_init(readings, curves, wanted, node)


def cal_c16_tsys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tsys(spark, sf_dir)
    return c.select("session", "antenna_no", "band", "tcell", r("tsys", 6).alias("tsys"), r("sefd", 4).alias("sefd"), r("a", 8).alias("a"), "fallback")


def cal_c16_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_share(_tsys(spark, sf_dir), ["antenna_no"]).select("antenna_no", r("share", 8).alias("share"), "n_cells")


def agg_a24_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tsys(spark, sf_dir).where("sefd is not null")
    q = quantiles(c, ["antenna_no"], "sefd", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return q.select("antenna_no", *[r(x, 4).alias(x) for x in ("q10", "q50", "q90")], "n")


def _windows(spark: SparkSession, sf_dir: str, band: Column | None = None) -> DataFrame:
    """Solved values per (p, i, tcell, fcell), from the readings of the first two bands or those of the condition."""
    st = table(spark, sf_dir, "system_temperature").where(has_antenna(F.col("antenna_no")) & finite(F.col("tsys_1")) & (F.col("band").between(1, 2) if band is None else band))
    g = st.groupBy(F.col("antenna_no").alias("p"), F.col("session").alias("tcell"), F.col("band").alias("fcell")).agg(F.median("tsys_1").alias("x"))
    return g.select("p", F.lit(1).alias("i"), "tcell", "fcell", (F.col("fcell") * 3.2e7 + 8.4e9).alias("nu"), (F.col("x") * 1e-12).alias("delay"), (F.col("x") / 100).alias("phase"))


def cal_c13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = derive_alignment(_windows(spark, sf_dir))
    return a.select("p", "i", "fcell", r(F.col("delay") * 1e12, 5).alias("delay_ps"), r("phase", 5).alias("phase"), "nruns")


def agg_a25_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_summary(derive_alignment(_windows(spark, sf_dir))).select("p", "i", r("rms", 5).alias("rms"), r("peak_to_peak", 5).alias("peak_to_peak"), r("d2_rms", 5).alias("d2_rms"))


def cal_c13_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment over all bands; antennas with fewer bands have their own sets of windows."""
    a = derive_alignment_by_setup(_windows(spark, sf_dir, F.col("band").isNotNull()))
    return a.select("p", "i", "setup", "fcell", r(F.col("delay") * 1e12, 9).alias("delay_ps"), r("phase", 5).alias("phase"), "nruns")


def agg_a25_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment_summary(derive_alignment_by_setup(_windows(spark, sf_dir, F.col("band").isNotNull())), ("p", "i", "setup"))
    return a.select("p", "i", "setup", r("rms", 5).alias("rms"), r("peak_to_peak", 5).alias("peak_to_peak"), r("d2_rms", 5).alias("d2_rms"))


def join_j2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one (session, baseline, source) closer than half an integration to the one before."""
    d = table(spark, sf_dir, "dataset").select("vis_id", "session", "a1", "a2", "source", micros(F.col("datetime")).alias("t"), "int_time")
    order = Window.partitionBy("session", "a1", "a2", "source").orderBy("t", "vis_id")
    return d.withColumn("gap_us", F.col("t") - F.lag("t").over(order)).where(F.col("gap_us") < F.col("int_time") * 5e5).select("vis_id", "gap_us")


def agg_a27_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    return d.groupBy("session", "scan").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("a1", "a2").alias("n_baselines"), F.count_if(present(F.col("weight"))).alias("n_present"), F.count("*").alias("n_rows"))


QUERIES = {f.__name__: f for f in (src_s4_facts, join_j3_unflagged, join_j4_cells, join_g10_first, join_j5_last_valid, join_j5_last_valid_ends, join_j6_bracketing, join_j7_names, join_j8_endpoints, cal_c15_pcal, sel_p15_health, sel_p15_pick, cal_c16_tsys, cal_c16_fallback, agg_a24_quantiles, cal_c13_alignment, agg_a25_alignment, cal_c13_setups, agg_a25_setups, join_j2_near_duplicates, agg_a27_census)}

_PI2 = repr(2 * math.pi) + "::DOUBLE"


def _wrap(x: str) -> str:
    return f"(({x}) - {_PI2} * round_even(({x}) / {_PI2}, 0))"


_CELLS = "sc AS (SELECT session, scan cell, min(epoch_us(datetime)) - 60000000 r_lo, max(epoch_us(datetime)) + 60000000 r_hi FROM dataset GROUP BY ALL)"


def _iv(tab: str, key: str) -> str:
    h = "CAST(round_even(interval * 5e5, 0) AS BIGINT)"
    return f"(SELECT {key}, session, antenna_no, epoch_us(time) - {h} lo, epoch_us(time) + {h} hi FROM {tab} WHERE interval IS NOT NULL AND NOT isnan(interval) AND interval >= 0 AND interval < 1e9)"


def _best(name: str, tab: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, cell FROM (SELECT {key}, cell, row_number() OVER (PARTITION BY {key} ORDER BY least(hi, r_hi) - greatest(lo, r_lo) DESC, cell) n
  FROM {_iv(tab, key)} JOIN sc USING (session) WHERE lo <= r_hi AND r_lo <= hi AND (least(hi, r_hi) - greatest(lo, r_lo) > 0 OR lo = hi)) WHERE n = 1)"""


_TONES = f"""{_CELLS}, {_best('tc', 'tones', 'tone_id')},
lt AS (SELECT session, antenna_no, cell tcell, 1 band, cable_cal cable, k tone, freq_1[k] freq, CAST(pcal_1_re[k] AS DOUBLE) re, CAST(pcal_1_im[k] AS DOUBLE) im FROM tones LEFT JOIN tc USING (tone_id), range(1, 3) x(k) WHERE antenna_no >= 1 AND k <= len(freq_1))"""
_HEALTH = """med AS (SELECT session, antenna_no, tone, median(sqrt(re * re + im * im)) m FROM lt GROUP BY ALL), rat AS (SELECT *, m / median(m) OVER (PARTITION BY session, antenna_no) ratio FROM med),
health AS (SELECT session, tone, bool_and(ratio >= 0.2) healthy, min(ratio) worst FROM rat GROUP BY ALL)"""
_TSYS = f"""{_CELLS}, {_best('tcs', 'system_temperature', 'st_id')},
rd AS (SELECT t.session, t.antenna_no, t.band, cell tcell, tsys_1 tsys FROM system_temperature t JOIN sessions s USING (session) LEFT JOIN tcs USING (st_id) WHERE antenna_no >= 1 AND isfinite(tsys_1) AND tsys_1 > 0 AND tsys_1 <= tsys_ceiling),
cu AS (SELECT session, antenna_no, band, dpfu_1, gain_1, x_typ_1 FROM (SELECT *, row_number() OVER (PARTITION BY session, antenna_no, band ORDER BY time DESC, gc_id DESC) n FROM gain_curve WHERE antenna_no >= 1 AND dpfu_1 IS NOT NULL AND y_typ_1 = 2) WHERE n = 1),
el AS (SELECT session, scan tcell, antenna_no, max(el) el FROM (SELECT session, scan, a1 a, el1 el FROM observables UNION ALL SELECT session, scan, a2, el2 FROM observables) JOIN (SELECT DISTINCT antenna_no, name FROM antennas) ON a = name GROUP BY ALL),
ct AS (SELECT session, antenna_no, band, tcell, median(tsys) v FROM rd WHERE tcell IS NOT NULL GROUP BY ALL), nt AS (SELECT session, antenna_no, band, median(tsys) v FROM rd GROUP BY ALL),
ts0 AS (SELECT session, antenna_no, band, tcell, coalesce(ct.v, nt.v) tsys, ct.v IS NULL fallback, dpfu_1, list_reduce(list_prepend(0e0, list_reverse(gain_1)), lambda acc, c: acc * CASE WHEN x_typ_1 = 0 THEN degrees(el) ELSE 90 - degrees(el) END + c) g
  FROM el JOIN cu USING (session, antenna_no) LEFT JOIN ct USING (session, antenna_no, band, tcell) LEFT JOIN nt USING (session, antenna_no, band)),
ts AS (SELECT *, CASE WHEN g > 0 AND dpfu_1 * g > 0 THEN tsys / (dpfu_1 * g) END sefd FROM ts0)"""
_ALIGN = f"""wn AS (SELECT antenna_no p, 1 i, session tcell, band fcell, band * 3.2e7 + 8.4e9 nu, median(tsys_1) * 1e-12 delay, median(tsys_1) / 100 phase FROM system_temperature WHERE antenna_no >= 1 AND isfinite(tsys_1) AND band BETWEEN 1 AND 2 GROUP BY antenna_no, session, band),
f1 AS (SELECT *, count(*) OVER w n_here, avg(delay) OVER w tb, (SELECT avg(nu) FROM (SELECT DISTINCT fcell, nu FROM wn)) nb FROM wn WINDOW w AS (PARTITION BY p, i, tcell)),
f2 AS (SELECT *, phase - {_PI2} * (nu - nb) * tb chi FROM f1 WHERE n_here = (SELECT count(DISTINCT fcell) FROM wn)),
f3 AS (SELECT *, chi - atan2(sum(sin(chi)) OVER w, sum(cos(chi)) OVER w) chi2 FROM f2 WINDOW w AS (PARTITION BY p, i, tcell)),
f4 AS (SELECT p, i, fcell, median(delay - tb) delay, atan2(sum(sin(chi2)), sum(cos(chi2))) phase, count(*) nruns FROM f3 GROUP BY ALL),
al AS (SELECT p, i, fcell, delay - avg(delay) OVER w delay, {_wrap('phase - atan2(sum(sin(phase)) OVER w, sum(cos(phase)) OVER w)')} phase, nruns FROM f4 WINDOW w AS (PARTITION BY p, i))"""

_SETUPS = f"""wn AS (SELECT antenna_no p, 1 i, session tcell, band fcell, band * 3.2e7 + 8.4e9 nu, median(tsys_1) * 1e-12 delay, median(tsys_1) / 100 phase FROM system_temperature WHERE antenna_no >= 1 AND isfinite(tsys_1) AND band IS NOT NULL GROUP BY antenna_no, session, band),
f2 AS (SELECT *, avg(delay) OVER w tb, array_to_string(list_sort(list(fcell) OVER w), ',') setup, phase - {_PI2} * (nu - avg(nu) OVER w) * avg(delay) OVER w chi FROM wn WINDOW w AS (PARTITION BY p, i, tcell)),
f3 AS (SELECT *, chi - atan2(sum(sin(chi)) OVER w, sum(cos(chi)) OVER w) chi2 FROM f2 WINDOW w AS (PARTITION BY p, i, tcell)),
f4 AS (SELECT p, i, setup, fcell, median(delay - tb) delay, atan2(sum(sin(chi2)), sum(cos(chi2))) phase, count(*) nruns FROM f3 GROUP BY ALL),
al AS (SELECT p, i, setup, fcell, delay - avg(delay) OVER w delay, {_wrap('phase - atan2(sum(sin(phase)) OVER w, sum(cos(phase)) OVER w)')} phase, nruns FROM f4 WINDOW w AS (PARTITION BY p, i, setup))"""

ORACLE = {
    "src_s4_facts": """
WITH d AS (SELECT session, min(epoch_us(datetime)) start_us, max(epoch_us(datetime)) stop_us, count(*) n_rows FROM dataset GROUP BY ALL),
m AS (SELECT *, make_timestamp((start_us + stop_us) // 2) mid FROM d)
SELECT session, start_us, stop_us, CAST(dayofyear(mid) AS INT) AS doy, round(year(mid) + (epoch_us(mid) - epoch_us(date_trunc('year', mid))) / (CASE WHEN year(mid) % 4 = 0 THEN 366 ELSE 365 END * 86400e6), 8) + 0 AS decimal_year, n_rows FROM m""",
    "join_j3_unflagged": f"""
WITH fl AS (SELECT session, name, lo, hi FROM {_iv('system_temperature', 'st_id, tsys_1')} JOIN (SELECT DISTINCT antenna_no, name FROM antennas) USING (antenna_no) WHERE tsys_1 IS NULL OR isnan(tsys_1) OR tsys_1 <= 0)
SELECT vis_id FROM dataset d WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.session = d.session AND (fl.name = d.a1 OR fl.name = d.a2) AND fl.lo <= epoch_us(d.datetime) + CAST(round_even(d.int_time * 1e6, 0) AS BIGINT) AND epoch_us(d.datetime) <= fl.hi)""",
    "join_j4_cells": f"WITH {_CELLS}, {_best('tc', 'tones', 'tone_id')} SELECT tone_id, cell FROM tc",
    "join_g10_first": f"WITH {_CELLS} SELECT obs_id, min(cell) AS cell FROM observables JOIN sc USING (session) WHERE epoch_us(datetime) BETWEEN r_lo AND r_hi GROUP BY obs_id",
    "join_j5_last_valid": """
WITH c AS (SELECT session, antenna_no, epoch_us(time) start, coalesce(dpfu_1, -1) dpfu FROM gain_curve WHERE antenna_no >= 1 AND band = 1),
q AS (SELECT obs_id, session, antenna_no, epoch_us(datetime) t FROM observables JOIN (SELECT DISTINCT antenna_no, name FROM antennas) ON a1 = name),
l AS (SELECT q.obs_id, q.antenna_no, t, start, dpfu, row_number() OVER (PARTITION BY q.obs_id ORDER BY start DESC NULLS LAST, dpfu DESC) n FROM q LEFT JOIN c ON q.session = c.session AND q.antenna_no = c.antenna_no AND c.start <= q.t)
SELECT obs_id, antenna_no, CASE WHEN t - start < 3000000000 THEN start END AS start, CASE WHEN t - start < 3000000000 THEN dpfu END AS dpfu FROM l WHERE n = 1""",
    "join_j6_bracketing": """
WITH s AS (SELECT session, antenna_no, epoch_us(time) s, avg(cable_cal) x FROM tones WHERE antenna_no >= 1 AND isfinite(cable_cal) GROUP BY ALL),
q AS (SELECT vis_id, session, antenna_no, epoch_us(datetime) t FROM dataset JOIN (SELECT DISTINCT antenna_no, name FROM antennas) ON a1 = name),
j AS (SELECT q.vis_id, q.t, a.s sa, a.x xa, b.s sb, b.x xb FROM q ASOF LEFT JOIN s a ON q.session = a.session AND q.antenna_no = a.antenna_no AND a.s <= q.t ASOF LEFT JOIN s b ON q.session = b.session AND q.antenna_no = b.antenna_no AND b.s >= q.t)
SELECT vis_id, round(CASE WHEN sa IS NULL THEN xb WHEN sb IS NULL OR sa = t THEN xa ELSE xa + (xb - xa) * ((t - sa) / (sb - sa)) END * 1e12, 6) + 0 AS cable_ps FROM j""",
    "join_j7_names": "WITH n AS (SELECT DISTINCT session, name FROM (SELECT session, a1 name FROM dataset UNION SELECT session, a2 FROM dataset)) SELECT session, n.name, antenna_no, CAST(dense_rank() OVER (PARTITION BY session ORDER BY n.name) AS INT) AS ix FROM n LEFT JOIN (SELECT DISTINCT antenna_no, name FROM antennas) a ON a.name = n.name",
    "join_j8_endpoints": "WITH a AS (SELECT name, max(x_m) x, max(y_m) y, max(z_m) z FROM antennas GROUP BY name) SELECT b.a1, b.a2, round(q.x - p.x, 3) + 0 AS dx, round(q.y - p.y, 3) + 0 AS dy, round(q.z - p.z, 3) + 0 AS dz, round(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2), 3) + 0 AS length FROM (SELECT DISTINCT a1, a2 FROM dataset) b JOIN a p ON p.name = a1 JOIN a q ON q.name = a2",
    "cal_c15_pcal": f"""
WITH {_TONES}, am AS (SELECT *, sqrt(re * re + im * im) amp, median(sqrt(re * re + im * im)) OVER (PARTITION BY session, antenna_no, band, tone) amed FROM lt WHERE NOT isnan(re) AND NOT isnan(im)),
g AS (SELECT session, antenna_no, tcell, band, sum(re) FILTER (tone = 1) r1, sum(im) FILTER (tone = 1) i1, sum(re) FILTER (tone = 2) r2, sum(im) FILTER (tone = 2) i2, min(freq) FILTER (tone = 1) f1, min(freq) FILTER (tone = 2) f2, coalesce(median(cable) FILTER (NOT isnan(cable)), 0) cab
  FROM am WHERE amp >= 0.3 * amed AND tcell IS NOT NULL GROUP BY ALL),
h AS (SELECT *, 1 / (f2 - f1) amb, {_wrap('atan2(i2, r2) - atan2(i1, r1)')} dphi FROM g WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND f2 > f1),
s AS (SELECT *, dphi / ({_PI2} * (f2 - f1)) + cab tau, {_wrap(f'atan2(i1, r1) + dphi / 2 + {_PI2} * (f1 + f2) / 2 * cab')} phi FROM h),
rf AS (SELECT session, antenna_no, band, min(amb) / {_PI2} * atan2(sum(sin(tau * {_PI2} / amb)), sum(cos(tau * {_PI2} / amb))) tr, atan2(sum(sin(phi)), sum(cos(phi))) pr FROM s GROUP BY ALL),
d AS (SELECT s.*, tr, pr, round_even((tau - tr) / amb, 0) turns FROM s JOIN rf USING (session, antenna_no, band)),
e AS (SELECT session, antenna_no, tcell, band, tau - tr - turns * amb delay, {_wrap('phi - pr - turns * pi()')} dp FROM d)
SELECT session, antenna_no, tcell, band, round(delay * 1e12, 3) + 0 AS delay_ps, round(cos(dp), 5) + 0 AS cos_phase, round(sin(dp), 5) + 0 AS sin_phase FROM e""",
    "sel_p15_health": f"WITH {_TONES}, {_HEALTH} SELECT session, tone, healthy, round(worst, 8) + 0 AS worst FROM health",
    "sel_p15_pick": f"WITH {_TONES}, {_HEALTH} SELECT a.session, min(a.tone) AS low, max(b.tone) AS high FROM health a JOIN health b ON a.session = b.session AND a.tone = 1 AND b.tone = 2 WHERE a.healthy AND b.healthy GROUP BY a.session",
    "cal_c16_tsys": f"WITH {_TSYS} SELECT session, antenna_no, band, tcell, round(tsys, 6) + 0 AS tsys, round(sefd, 4) + 0 AS sefd, round(0.5 * ln(0.88) - 0.5 * ln(sefd), 8) + 0 AS a, fallback FROM ts",
    "cal_c16_fallback": f"WITH {_TSYS} SELECT antenna_no, round(avg(CAST(fallback AS INT)), 8) + 0 AS share, count(*) AS n_cells FROM ts GROUP BY ALL",
    "agg_a24_quantiles": f"WITH {_TSYS} SELECT antenna_no, round(quantile_cont(sefd, 0.1), 4) + 0 AS q10, round(quantile_cont(sefd, 0.5), 4) + 0 AS q50, round(quantile_cont(sefd, 0.9), 4) + 0 AS q90, count(*) AS n FROM ts WHERE sefd IS NOT NULL GROUP BY ALL",
    "cal_c13_alignment": f"WITH {_ALIGN} SELECT p, i, fcell, round(delay * 1e12, 5) + 0 AS delay_ps, round(phase, 5) + 0 AS phase, nruns FROM al",
    "agg_a25_alignment": f"WITH {_ALIGN}, x AS (SELECT *, {_wrap('lag(phase) OVER w - 2 * phase + lead(phase) OVER w')} d2 FROM al WINDOW w AS (PARTITION BY p, i ORDER BY fcell)) SELECT p, i, round(sqrt(avg(phase * phase)), 5) + 0 AS rms, round(max(phase) - min(phase), 5) + 0 AS peak_to_peak, round(sqrt(avg(d2 * d2)), 5) + 0 AS d2_rms FROM x GROUP BY ALL",
    "cal_c13_setups": f"WITH {_SETUPS} SELECT p, i, setup, fcell, round(delay * 1e12, 9) + 0 AS delay_ps, round(phase, 5) + 0 AS phase, nruns FROM al",
    "agg_a25_setups": f"WITH {_SETUPS}, x AS (SELECT *, {_wrap('lag(phase) OVER w - 2 * phase + lead(phase) OVER w')} d2 FROM al WINDOW w AS (PARTITION BY p, i, setup ORDER BY fcell)) SELECT p, i, setup, round(sqrt(avg(phase * phase)), 5) + 0 AS rms, round(max(phase) - min(phase), 5) + 0 AS peak_to_peak, round(sqrt(avg(d2 * d2)), 5) + 0 AS d2_rms FROM x GROUP BY ALL",
    "join_j5_last_valid_ends": """
WITH c AS (SELECT session, antenna_no, band, epoch_us(time) start, coalesce(dpfu_1, -1) dpfu FROM gain_curve WHERE antenna_no >= 1),
q AS (SELECT obs_id, side, e.session, n.antenna_no, band, t FROM (SELECT obs_id, 1 side, session, a1 a, epoch_us(datetime) t FROM observables UNION ALL SELECT obs_id, 2, session, a2, epoch_us(datetime) FROM observables) e
  JOIN (SELECT DISTINCT antenna_no, name FROM antennas) n ON a = name LEFT JOIN (SELECT DISTINCT session, antenna_no, band FROM c) b ON b.session = e.session AND b.antenna_no = n.antenna_no),
l AS (SELECT q.obs_id, q.side, q.antenna_no, q.band, t, start, dpfu, row_number() OVER (PARTITION BY q.obs_id, q.side, q.antenna_no, q.band ORDER BY start DESC NULLS LAST, dpfu DESC) n FROM q LEFT JOIN c ON q.session = c.session AND q.antenna_no = c.antenna_no AND q.band IS NOT DISTINCT FROM c.band AND c.start <= q.t)
SELECT obs_id, side, antenna_no, band, CASE WHEN t - start < 3000000000 THEN start END AS start, CASE WHEN t - start < 3000000000 THEN dpfu END AS dpfu FROM l WHERE n = 1""",
    "join_j2_near_duplicates": "SELECT vis_id, g AS gap_us FROM (SELECT vis_id, int_time, epoch_us(datetime) - lag(epoch_us(datetime)) OVER (PARTITION BY session, a1, a2, source ORDER BY datetime, vis_id) g FROM dataset) WHERE g < int_time * 5e5",
    "agg_a27_census": "SELECT session, scan, count(DISTINCT source) AS n_sources, count(DISTINCT (a1, a2)) AS n_baselines, count(*) FILTER (weight > 0 AND NOT isnan(weight)) AS n_present, count(*) AS n_rows FROM dataset GROUP BY ALL",
}
