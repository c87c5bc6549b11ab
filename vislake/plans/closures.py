"""Queries on Stokes-I data and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators.average import C_LIGHT, MAS, average, average_rows
from vislake.operators.closure import closure_amp_chi2, closure_chi2, divide_model, edges, fit_beam, map_sigma, model_visibility, noise_scale, noise_series, significant, stokes_i, triangles, uniform_weights
from vislake.plans.common import CELLS_CTE, cells, r, vis, with_vis
from vislake.plans.visibility import _AVG, _ROWS, solution
from vislake.sources.adapters import DNU, IF_STEP, NU0

#: Two components per source: flux in Jy, offsets in mas that grow with the source's number.
_SECOND = 0.3


def _models(spark: SparkSession) -> DataFrame:
    c = F.array(F.struct(F.lit(1.0).alias("flux"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(_SECOND).alias("flux"), (F.col("s") * 0.1).alias("x"), (F.col("s") * -0.05).alias("y")))
    return spark.range(1, 11).select(F.col("id").cast("int").alias("source"), F.col("id").cast("double").alias("s")).select("source", c.alias("components"))


def _stokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stokes I of cell averages: every (source, year, window) has many baselines."""
    c = cells(spark, sf_dir)
    rows = average_rows(c.groupBy("row_id", "source", "p", "q", "tcell", "scan").agg(F.sum("w").alias("w_row"), F.min("u").alias("u"), F.min("v").alias("v"), F.lit(1.0).alias("int_time")))
    a = average(c).join(rows.select("source", "p", "q", "tcell", "u", "v"), ["source", "p", "q", "tcell"]).join(F.broadcast(solution(spark).fcells.select(F.col("cell").alias("fcell"), F.col("ref").alias("nu"))), "fcell")
    return stokes_i(a.select(F.lit(1).alias("row_id"), "source", "p", "q", F.col("tcell").alias("scan"), F.col("tcell").cast("double").alias("t"), F.col("fcell").alias("chan"), "nu", "i", "j", "u", "v", "re", "im", "w"))


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stokes(spark, sf_dir).join(_models(spark), "source")
    m = model_visibility(F.col("components"), F.col("u"), F.col("v"))
    return s.withColumn("model_re", m.re).withColumn("model_im", m.im).drop("components")


def sel_p9_stokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stokes_i(vis(spark, sf_dir))
    return s.select("row_id", "source", "p", "q", "scan", "t", "chan", r("u", 8).alias("u"), r("v", 8).alias("v"), r("re", 8).alias("re"), r("im", 8).alias("im"), r("w", 6).alias("w"))


def sel_p10_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = divide_model(_stokes(spark, sf_dir), _models(spark), 0.6)
    return d.select("source", "p", "q", "t", "chan", r("re").alias("re"), r("im").alias("im"), r("w", 3).alias("w"))


def sel_p16_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(_models(spark).select("source", F.explode("components").alias("c")).select("source", "c.flux", "c.x", "c.y"), 0.1, 5.0)


def agg_a8_noise_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stokes_i(vis(spark, sf_dir)).withColumn("scan", F.floor(F.col("scan") / 12).cast("int")).withColumn("row_id", F.struct("row_id", "re", "im"))
    return noise_series(s).select("source", "p", "q", "chan", "scan", r("k", 8).alias("k"))


def agg_a8_noise_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stokes_i(vis(spark, sf_dir)).withColumn("scan", F.floor(F.col("scan") / 12).cast("int")).withColumn("row_id", F.struct("row_id", "re", "im"))
    return noise_scale(s).select(r("k", 8).alias("k"), "n_series")


def agg_a9_map_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_sigma(_stokes(spark, sf_dir).withColumn("wt", F.col("w")), 2.0).select("source", r("sigma", 8).alias("sigma"))


def agg_a10_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_weights(_stokes(spark, sf_dir), 64, 0.5).select("source", "p", "q", "t", "chan", r("wt", 8).alias("wt"))


def agg_a11_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_beam(_stokes(spark, sf_dir)).select("source", r("sigma_major", 6).alias("sigma_major"), r("ratio").alias("ratio"), r("pa", 5).alias("pa"))


def join_j9_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triangles(edges(_stokes(spark, sf_dir), 1.0))
    # Cosine and sine: a phase of pi and one of -pi are the same.
    return t.select("source", "t", "chan", "a", "b", "c", r(F.cos("phase"), 5).alias("cos_phase"), r(F.sin("phase"), 5).alias("sin_phase"))


def agg_a12_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure_chi2(edges(_modelled(spark, sf_dir), 1e-3), ["source"]).select("source", r("chi2", 5).alias("chi2"), "n")


def agg_a13_closure_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure_amp_chi2(edges(_modelled(spark, sf_dir), 1.0), 2.0, ["source"]).select("source", r("chi2", 4).alias("chi2"), r("rms").alias("rms"), "n")


QUERIES = {f.__name__: f for f in (sel_p9_stokes, sel_p10_model, sel_p16_significant, agg_a8_noise_series, agg_a8_noise_scale, agg_a9_map_sigma, agg_a10_uniform, agg_a11_beam, join_j9_triangles, agg_a12_closure, agg_a13_closure_amp)}

_UV = repr(-1.0 * MAS / C_LIGHT) + "::DOUBLE"


def _stokes_sql(name: str, src: str) -> str:
    return f"""{name}_d AS (SELECT row_id, source, p, q, scan, t, chan, nu, max(re) FILTER (i = 1) r1, max(im) FILTER (i = 1) i1, max(w) FILTER (i = 1) w1, max(re) FILTER (i = 2) r2, max(im) FILTER (i = 2) i2, max(w) FILTER (i = 2) w2, min(u) um, min(v) vm FROM {src} WHERE i = j AND w > 0 GROUP BY row_id, source, p, q, scan, t, chan, nu),
{name} AS (SELECT row_id, source, p, q, scan, t, chan, um * nu * {_UV} u, vm * nu * {_UV} v, CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN (r1 + r2) / 2 ELSE coalesce(r1, r2) END re, CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN (i1 + i2) / 2 ELSE coalesce(i1, i2) END im,
  CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN 4 * w1 * w2 / (w1 + w2) ELSE coalesce(w1, w2) END w FROM {name}_d)"""


_ST = [CELLS_CTE, _AVG.format(src="cells"), _ROWS, f"""stin AS (SELECT 1 row_id, avg_.source, avg_.p, avg_.q, tcell scan, CAST(tcell AS DOUBLE) t, fcell chan, CASE WHEN fcell = 1 THEN {NU0 + 1.5 * DNU}::DOUBLE ELSE {NU0 + 5 * DNU + IF_STEP}::DOUBLE END nu, i, j, u, v, re, im, w
  FROM avg_ JOIN arows USING (source, p, q, tcell))""", _stokes_sql("st", "stin")]
_MODEL = f"""sm AS (SELECT *, 1 + {_SECOND} * cos(6.283185307179586e0 * (u * source * 0.1e0 - v * source * 0.05e0)) mr, {_SECOND} * sin(6.283185307179586e0 * (u * source * 0.1e0 - v * source * 0.05e0)) mi FROM st)"""
_WRAP = "({0} - 6.283185307179586e0 * round_even(({0}) / 6.283185307179586e0, 0))"
_TRI = """tri AS (SELECT x.source, x.t, x.chan, x.p a, x.q b, y.q c, x.ph + y.ph - z.ph phase, x.mph + y.mph - z.mph mphase, x.v + y.v + z.v var
  FROM e x JOIN e y ON x.source = y.source AND x.t = y.t AND x.chan = y.chan AND x.q = y.p JOIN e z ON x.source = z.source AND x.t = z.t AND x.chan = z.chan AND z.p = x.p AND z.q = y.q)"""


def _edges_sql(scale: str, src: str = "st", model: bool = False) -> str:
    m = "atan2(mi, mr) mph, ln(sqrt(mr * mr + mi * mi)) ml" if model else "0e0 mph, 0e0 ml"
    return f"e AS (SELECT source, t, chan, p, q, atan2(im, re) ph, ln(sqrt(re * re + im * im)) l, 1 / ((re * re + im * im) * w * {scale}) v, {m} FROM {src} WHERE w > 0 AND re * re + im * im > 0)"


def _pairing(k1: str, k2: str, k3: str, k4: str) -> str:
    name = {"ab": "ab", "cd": "cd", "ac": "ac", "bd": "bd", "ad": "ad", "bc": "bc"}
    on = "e {n} ON {n}.source = b0.source AND {n}.t = b0.t AND {n}.chan = b0.chan AND {n}.p = b0.{x} AND {n}.q = b0.{y}"
    joins = " JOIN ".join(on.format(n=name[k], x=k[0], y=k[1]) for k in (k1, k2, k3, k4))
    d = f"{k1}.l - {k1}.ml + {k2}.l - {k2}.ml - {k3}.l + {k3}.ml - {k4}.l + {k4}.ml"
    return f"SELECT b0.source, {d} d, {k1}.v + {k2}.v + {k3}.v + {k4}.v var FROM base b0 JOIN {joins}"


_QUAD = f"""ge AS (SELECT * FROM e WHERE v <= 0.25e0), ants AS (SELECT source, t, chan, p x FROM ge UNION SELECT source, t, chan, q FROM ge),
base AS (SELECT w.source, w.t, w.chan, w.x a, x.x b, y.x c, z.x d FROM ants w JOIN ants x ON w.source = x.source AND w.t = x.t AND w.chan = x.chan AND w.x < x.x JOIN ants y ON w.source = y.source AND w.t = y.t AND w.chan = y.chan AND x.x < y.x JOIN ants z ON w.source = z.source AND w.t = z.t AND w.chan = z.chan AND y.x < z.x),
quads AS ({_pairing('ab', 'cd', 'ac', 'bd')} UNION ALL {_pairing('ab', 'cd', 'ad', 'bc')} UNION ALL {_pairing('ac', 'bd', 'ad', 'bc')})""".replace("JOIN e ", "JOIN ge ")
_SERIES = """ser AS (SELECT *, scan // 12 yr, lag(re, 2) OVER o - 2 * lag(re, 1) OVER o + re dr, lag(im, 2) OVER o - 2 * lag(im, 1) OVER o + im di FROM sv WINDOW o AS (PARTITION BY source, p, q, chan, scan // 12 ORDER BY t, row_id, re, im)),
ks AS (SELECT source, p, q, chan, CAST(yr AS INT) scan, 6 * count(dr) / (sum(dr * dr + di * di) * avg(w)) k FROM ser GROUP BY ALL HAVING count(dr) > 0 AND sum(dr * dr + di * di) > 0 AND avg(w) > 0)"""

ORACLE = {
    "sel_p9_stokes": with_vis("SELECT row_id, source, p, q, scan, t, chan, round(u, 8) + 0 AS u, round(v, 8) + 0 AS v, round(re, 8) + 0 AS re, round(im, 8) + 0 AS im, round(w, 6) + 0 AS w FROM sv", _stokes_sql("sv", "vis")),
    "sel_p10_model": with_vis("SELECT source, p, q, t, chan, round(CASE WHEN weak THEN re ELSE (re * mr + im * mi) / m2 END, 6) + 0 AS re, round(CASE WHEN weak THEN im ELSE (im * mr - re * mi) / m2 END, 6) + 0 AS im, round(CASE WHEN weak THEN 0 ELSE w * m2 END, 3) + 0 AS w FROM (SELECT *, mr * mr + mi * mi m2, sqrt(mr * mr + mi * mi) < 0.6e0 * 1.3e0 weak FROM sm)", *_ST, _MODEL),
    "sel_p16_significant": "SELECT CAST(s AS INT) AS source, 1e0 AS flux, 0e0 AS x, 0e0 AS y FROM range(1, 11) r(s)",
    "agg_a8_noise_series": with_vis("SELECT source, p, q, chan, scan, round(k, 8) + 0 AS k FROM ks", _stokes_sql("sv", "vis"), _SERIES),
    "agg_a8_noise_scale": with_vis("SELECT round(median(k), 8) + 0 AS k, count(*) AS n_series FROM ks", _stokes_sql("sv", "vis"), _SERIES),
    "agg_a9_map_sigma": with_vis("SELECT source, round(sqrt(sum(w) / 4) / sum(w), 8) + 0 AS sigma FROM st GROUP BY source", *_ST),
    "agg_a10_uniform": with_vis("SELECT source, p, q, t, chan, round(w / sum(w) OVER (PARTITION BY source, round_even(u * 32, 0), round_even(v * 32, 0)), 8) + 0 AS wt FROM st", *_ST),
    "agg_a11_beam": with_vis("SELECT source, round(sqrt(mj), 6) + 0 AS sigma_major, round(sqrt(mn / mj), 6) + 0 AS ratio, round(pa - pi() * ceil(pa / pi() - 0.5), 5) + 0 AS pa FROM (SELECT *, atan2(b, mj - a) pa FROM (SELECT *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) mj, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) mn FROM (SELECT source, vv / (d * 4 * pi() ** 2) a, -uv / (d * 4 * pi() ** 2) b, uu / (d * 4 * pi() ** 2) c FROM (SELECT *, uu * vv - uv * uv d FROM (SELECT source, sum(w * u * u) / sum(w) uu, sum(w * v * v) / sum(w) vv, sum(w * u * v) / sum(w) uv FROM st GROUP BY source)))))", *_ST),
    "join_j9_triangles": with_vis("SELECT source, t, chan, a, b, c, round(cos(phase), 5) + 0 AS cos_phase, round(sin(phase), 5) + 0 AS sin_phase FROM tri", *_ST, _edges_sql("1e0"), _TRI),
    "agg_a12_closure": with_vis(f"SELECT source, round(avg({_WRAP.format('(' + _WRAP.format('phase') + ' - ' + _WRAP.format('mphase') + ')')} ** 2 / var), 5) + 0 AS chi2, count(*) AS n FROM tri GROUP BY source", *_ST, _MODEL, _edges_sql("1e-3", "sm", True), _TRI),
    "agg_a13_closure_amp": with_vis("SELECT source, round(avg(d * d / var), 4) + 0 AS chi2, round(sqrt(avg(d * d)), 6) + 0 AS rms, count(*) AS n FROM quads GROUP BY source", *_ST, _MODEL, _edges_sql("1e0", "sm", True), _QUAD),
}
