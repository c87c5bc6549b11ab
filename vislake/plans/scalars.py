"""Queries of scalar functions (F rows, P17, P18, P21), on registers and observables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.functions import columns as fc
from vislake.functions import delaymodel as dm
from vislake.functions.complexmath import wrap
from vislake.operators.timejoin import horner
from vislake.plans.common import channels, r, with_vis
from vislake.plans.inspect import channel_order
from vislake.session import finite, micros, table


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "observables").where(finite(F.col("el1")) & (F.col("el1") > 0.05))


def fn_f1_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset").select("vis_id", r(wrap(F.col("t") * 0.37), 7).alias("wrapped"))


def fn_f3_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sessions").select("session", "time0")
    return table(spark, sf_dir, "dataset").join(s, "session").select("vis_id", micros(fc.at_time(F.col("time0"), F.col("t"))).alias("us"))


def fn_f4_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "sessions")
    mjd = micros(F.col("time0")) / 86400e6 + 40587
    leap = F.size(F.filter(F.array(*[F.lit(float(x)) for x in dm.LEAP_MJD]), lambda x: x <= mjd)) + 9
    return d.select("session", r(mjd, 8).alias("mjd"), leap.alias("tai_utc"), F.dayofyear("time0").alias("doy"), r(F.pmod(micros(F.col("time0")) / 3600e6, F.lit(24.0)), 8).alias("ut_hours"))


def fn_f11_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.lit(0.61)
    o = _obs(spark, sf_dir)
    return o.select("obs_id", r(fc.wet_mapping(F.col("el1"), lat), 7).alias("wet"), r(fc.hydrostatic_mapping(F.col("el1"), lat, F.lit(400.0), F.lit(120.0)), 7).alias("dry"), r(fc.gradient_mapping(F.col("el1")), 7).alias("grad"))


def fn_f12_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "antennas")
    h = F.abs("z_m") / 2000
    return a.select("name", "added_at", r(fc.standard_pressure(h), 6).alias("pressure"), r(fc.zenith_hydrostatic(fc.standard_pressure(h), F.col("x_m") / 1e7, h), 8).alias("zenith"))


def fn_f14_iono(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.degrees("el1")
    return _obs(spark, sf_dir).select("obs_id", r(fc.petrov_mapping(e, 450e3, 6371e3), 8).alias("petrov"), r(fc.single_layer_mapping(e, 450e3, 6371e3), 8).alias("slm"), r(fc.tec_delay(F.col("snr"), F.lit(8.4e9)) * 1e12, 5).alias("delay_ps"))


def fn_f16_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gain_curve").where("size(gain_1) > 0")
    return g.select("gc_id", r(horner(F.col("gain_1"), F.lit(37.5)), 11).alias("gain"))


def fn_f17_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = fc.uv_from_partials(F.col("el1") * 0.01, F.col("el2") * 0.01, F.lit(8.4e9))
    return _obs(spark, sf_dir).select("obs_id", r(u, 8).alias("u"), r(v, 8).alias("v"))


def fn_f19_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = fc.absolute_position(F.col("source_rawid") * 1.0, F.col("source_rawid") * -0.5, F.radians("ra_deg"), F.radians("dec_deg"))
    return table(spark, sf_dir, "sources").select("source_rawid", "added_at", r(ra * 1e6, 4).alias("ra_urad"), r(dec * 1e6, 4).alias("dec_urad"))


def fn_f22_sexagesimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").select("source_rawid", "added_at", fc.ra_sexagesimal(F.radians("ra_deg")).alias("ra"), fc.dec_sexagesimal(F.radians("dec_deg")).alias("dec"))


def fn_f23_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").select("source_rawid", "added_at", fc.filled_template("models/{src}_{epoch}.mod", F.col("name"), F.lit("2024")).alias("path"), fc.slug(F.concat(F.lit("Own Set: "), F.col("rfc_jname"))).alias("slug"))


def fn_f24_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "antennas").select("name", "poltypes").dropDuplicates(["name"])
    d = table(spark, sf_dir, "dataset").select("a1", "a2").distinct()
    j = d.join(a.select(F.col("name").alias("a1"), F.col("poltypes").alias("p1")), "a1").join(a.select(F.col("name").alias("a2"), F.col("poltypes").alias("p2")), "a2")
    return j.select("a1", "a2", fc.product_label(F.col("p1"), F.col("p2"), F.lit(1), F.lit(1)).alias("l11"), fc.product_label(F.col("p1"), F.col("p2"), F.lit(2), F.lit(2)).alias("l22"))


def sel_p17_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fc.without_term(["tau_total", "delay"], "tau_ionosphere")
    o = table(spark, sf_dir, "observables").withColumns(c)
    return o.select("obs_id", r(F.col("tau_total") * 1e12, 2).alias("tau_total"), r(F.col("delay") * 1e12, 2).alias("delay"))


def sel_p18_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "observables")
    return o.groupBy("session").agg(F.count_if(F.isnan(fc.matched_nan(F.col("snr"), F.col("tau_residual")))).alias("n_nan"), F.count("*").alias("n"))


def sel_p21_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = fc.longitude_latitude(F.col("x_m"), F.col("y_m"), F.col("z_m"))
    return table(spark, sf_dir, "antennas").select("name", "added_at", r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


def sel_p21_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_order(channels(spark))


QUERIES = {f.__name__: f for f in (fn_f1_wrap, fn_f3_time, fn_f4_epochs, fn_f11_mappings, fn_f12_zenith, fn_f14_iono, fn_f16_polynomial, fn_f17_uv, fn_f19_absolute, fn_f22_sexagesimal, fn_f23_templates, fn_f24_labels, sel_p17_terms, sel_p18_matched, sel_p21_lonlat, sel_p21_channels)}

_PI2 = "6.283185307179586::DOUBLE"
_OBS = "(SELECT * FROM observables WHERE isfinite(el1) AND el1 > 0.05)"


def _table(row: list[float]) -> str:
    """The same five-point table at latitude 0.61 rad (34.95 degrees): between 30 and 45."""
    return f"({row[1]!r}::DOUBLE + (degrees(0.61e0) - 30) * ({row[2]!r}::DOUBLE - {row[1]!r}::DOUBLE) / 15)"


def _cf(s: str, a: str, b: str, c: str) -> str:
    return f"((1 + {a} / (1 + {b} / (1 + {c}))) / ({s} + {a} / ({s} + {b} / ({s} + {c}))))"


_WET = _cf("sin(el1)", *[_table(x.tolist()) for x in dm.NIELL_WET])
_DRY = _cf("sin(el1)", *[f"({_table(m.tolist())} - {_table(a.tolist())} * cos((120e0 - 28) * {_PI2} / 365.25))" for m, a in zip(dm.NIELL_DRY, dm.NIELL_DRY_AMP)])
_HEIGHT = _cf("sin(el1)", *[f"{x!r}::DOUBLE" for x in dm.NIELL_HEIGHT])
_P = "(1013.25e0 * pow(1 - 2.25577e-5 * abs(z_m) / 2000, 5.2559e0))"
_BR = 6371e3 / (6371e3 + 450e3 + dm.PETROV_DH)
_SR = 6371e3 / (6371e3 + 450e3)
_B = dm.EARTH_RADIUS * (1 - dm.FLATTENING)
_E2 = dm.FLATTENING * (2 - dm.FLATTENING)

ORACLE = {
    "fn_f1_wrap": f"SELECT vis_id, round(t * 0.37 - {_PI2} * round_even(t * 0.37 / {_PI2}, 0), 7) + 0 AS wrapped FROM dataset",
    "fn_f3_time": "SELECT vis_id, epoch_us(time0) + CAST(round_even(t * 1e6, 0) AS BIGINT) AS us FROM dataset JOIN sessions USING (session)",
    "fn_f4_epochs": f"SELECT session, round(epoch_us(time0) / 86400e6 + 40587, 8) + 0 AS mjd, CAST(len(list_filter({dm.LEAP_MJD.tolist()}, lambda x: x <= epoch_us(time0) / 86400e6 + 40587)) + 9 AS INT) AS tai_utc, CAST(dayofyear(time0) AS INT) AS doy, round((epoch_us(time0) / 3600e6) % 24, 8) + 0 AS ut_hours FROM sessions",
    "fn_f11_mappings": f"SELECT obs_id, round({_WET}, 7) + 0 AS wet, round({_DRY} + (1 / sin(el1) - {_HEIGHT}) * 0.4e0, 7) + 0 AS dry, round(1 / (sin(el1) * tan(el1) + 0.0032), 7) + 0 AS grad FROM {_OBS}",
    "fn_f12_zenith": f"SELECT name, added_at, round({_P}, 6) + 0 AS pressure, round(0.0022768 * {_P} / (1 - 0.00266 * cos(2 * x_m / 1e7) - 0.00028 * (abs(z_m) / 2000) / 1000), 8) + 0 AS zenith FROM antennas",
    "fn_f14_iono": f"SELECT obs_id, round({dm.PETROV_K} / sqrt(1 - (cos(el1 * {dm.PETROV_ALPHA}) * {_BR!r}::DOUBLE) ** 2), 8) + 0 AS petrov, round(1 / sqrt(1 - (cos(el1) * {_SR!r}::DOUBLE) ** 2), 8) + 0 AS slm, round(snr * {dm.K_ION / dm.C_LIGHT * dm.TECU!r}::DOUBLE / (8.4e9 * 8.4e9) * 1e12, 5) + 0 AS delay_ps FROM {_OBS}",
    "fn_f16_polynomial": "SELECT gc_id, round(list_reduce(list_prepend(0e0, list_reverse(gain_1)), lambda a, c: a * 37.5e0 + c), 11) + 0 AS gain FROM gain_curve WHERE len(gain_1) > 0",
    "fn_f17_uv": f"SELECT obs_id, round(el1 * 0.01 * -8.4e9 * {fc.MAS!r}::DOUBLE, 8) + 0 AS u, round(el2 * 0.01 * -8.4e9 * {fc.MAS!r}::DOUBLE, 8) + 0 AS v FROM {_OBS}",
    "fn_f19_absolute": f"SELECT source_rawid, added_at, round((radians(ra_deg) + source_rawid * {fc.MAS!r}::DOUBLE / cos(radians(dec_deg))) * 1e6, 4) + 0 AS ra_urad, round((radians(dec_deg) - 0.5 * source_rawid * {fc.MAS!r}::DOUBLE) * 1e6, 4) + 0 AS dec_urad FROM sources",
    "fn_f22_sexagesimal": """
WITH s AS (SELECT source_rawid, added_at, dec_deg, CAST(round_even(ra_deg / 15 * 3600e6, 0) AS BIGINT) a, CAST(round_even(abs(dec_deg) * 3600e5, 0) AS BIGINT) d FROM sources)
SELECT source_rawid, added_at, printf('%02d %02d %09.6f', a // 3600000000 % 24, a // 60000000 % 60, a % 60000000 / 1e6) AS ra,
       CASE WHEN dec_deg < 0 THEN '-' ELSE '+' END || printf('%02d %02d %08.5f', d // 360000000, d // 6000000 % 60, d % 6000000 / 1e5) AS dec FROM s""",
    "fn_f23_templates": "SELECT source_rawid, added_at, 'models/' || name || '_2024.mod' AS path, trim(regexp_replace(lower('Own Set: ' || rfc_jname), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM sources",
    "fn_f24_labels": "WITH a AS (SELECT name, any_value(poltypes) p FROM antennas GROUP BY name) SELECT d.a1, d.a2, coalesce(x.p[1], '?') || coalesce(y.p[1], '?') AS l11, coalesce(x.p[2], '?') || coalesce(y.p[2], '?') AS l22 FROM (SELECT DISTINCT a1, a2 FROM dataset) d JOIN a x ON x.name = a1 JOIN a y ON y.name = a2",
    "sel_p17_terms": "SELECT obs_id, round((tau_total - tau_ionosphere) * 1e12, 2) + 0 AS tau_total, round((delay - tau_ionosphere) * 1e12, 2) + 0 AS delay FROM observables",
    "sel_p18_matched": "SELECT session, count(*) FILTER (CASE WHEN isnan(tau_residual) THEN true ELSE isnan(snr) END) AS n_nan, count(*) AS n FROM observables GROUP BY session",
    "sel_p21_lonlat": f"WITH u AS (SELECT *, sqrt(x_m * x_m + y_m * y_m) p, atan2(z_m * {dm.EARTH_RADIUS}::DOUBLE, sqrt(x_m * x_m + y_m * y_m) * {_B!r}::DOUBLE) u FROM antennas) SELECT name, added_at, round(degrees(atan2(y_m, x_m)), 7) + 0 AS lon, round(degrees(atan2(z_m + {_E2 / (1 - _E2) * _B!r}::DOUBLE * sin(u) ** 3, p - {_E2 * dm.EARTH_RADIUS!r}::DOUBLE * cos(u) ** 3)), 7) + 0 AS lat FROM u",
    "sel_p21_channels": with_vis("SELECT chan, nu, if_id, CAST(row_number() OVER o AS INT) AS rank, coalesce(if_id <> lag(if_id) OVER o, false) AS breaks FROM channels WINDOW o AS (ORDER BY nu, chan)"),
}
