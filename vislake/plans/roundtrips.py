"""Readers and writers on files made from the tables: what is read back must be what SQL finds in the tables.

Files are written by tasks into the shared folder (a mounted one, which the readers need anyway) and deleted with the driver.
"""

from __future__ import annotations

import io
import math
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.functions import delaymodel as dm
from vislake.operators.partition import gap_scans
from vislake.plans.common import channels, r
from vislake.plans.session_run import open_files
from vislake.session import ensure_utc, finite, micros, shared_dir, table
from vislake.sources import fits, readers, sinks
from vislake.sources.adapters import DNU, NU0

#: Files that the visibilities are spread over.
FILES = 4
#: Start of the clock of the written files: 2000-01-01.
DAY0_JD, DAY0_US = 2_451_544.5, 946_684_800_000_000


def _folder(spark: SparkSession) -> str:
    ensure_utc(spark)
    root = shared_dir(spark)
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    out = os.path.join(root, f"files-{uuid.uuid4().hex}")
    Path(out).mkdir(parents=True)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{out}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def _written(rows: DataFrame, folder: str) -> list[str]:
    """Paths of FITS-IDI files of one channel and product with all rows, in FILES parts by vis_id."""
    axes = [fits.card(k, v) for k, v in (("MAXIS", 4), ("CTYPE1", "COMPLEX"), ("MAXIS1", 3), ("CTYPE2", "STOKES"), ("MAXIS2", 1), ("CTYPE3", "FREQ"), ("MAXIS3", 1), ("CTYPE4", "BAND"), ("MAXIS4", 1))]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        second = lambda c: pdf[c].to_numpy(float) / dm.C_LIGHT
        cols = {
            "UU": second("u_m"), "VV": second("v_m"), "WW": second("w_m"), "DATE": np.full(len(pdf), DAY0_JD), "TIME": (pdf["us"].to_numpy(np.int64) - DAY0_US) / 86_400e6,
            "BASELINE": (256 * pdf["p"] + pdf["q"]).to_numpy("i4"), "SOURCE": pdf["source_ix"].fillna(0).to_numpy("i4"), "INTTIM": pdf["int_time"].to_numpy(float), "FLUX": pdf[["re", "im", "weight"]].to_numpy(float),
        }
        path = f"{folder}/{pdf['part'].iloc[0]}.fits"
        Path(path).write_bytes(fits.header([fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 0)]) + fits.table_bytes("UV_DATA", cols, axes))
        return pd.DataFrame({"path": [path]})

    return sorted(x["path"] for x in rows.withColumn("part", F.pmod("vis_id", F.lit(FILES))).groupBy("part").applyInPandas(write, "path string").collect())  # FILES names


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return table(spark, sf_dir, "dataset").select("vis_id", "p", "q", "source_ix", micros(F.col("datetime")).alias("us"), "u_m", "v_m", "w_m", "int_time", number("vis_re").alias("re"), number("vis_im").alias("im"), "weight")


def src_s1_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset table as FITS-IDI files, loaded and put together again; autocorrelations are dropped by the loader."""
    out = None
    for v in fits.load(spark, _written(_rows(spark, sf_dir), _folder(spark))).values():
        out = v if out is None else out.unionByName(v)
    return out.select("p", "q", F.col("source").alias("source_ix"), r("t", 3).alias("t"), r("u_m", 3).alias("u_m"), r("int_time", 3).alias("int_time"), r("re", 6).alias("re"), r("im", 6).alias("im"), r("w", 6).alias("w"))


def src_s2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files opened as one data set, with scans by gaps and sources (rows sent again are left out before writing)."""
    folder = _folder(spark)
    key = ["p", "q", "source_ix", "us"]
    once = _rows(spark, sf_dir).where("p <> q").groupBy(*key).agg(F.min_by(F.struct("vis_id", "u_m", "v_m", "w_m", "int_time", "re", "im", "weight"), "vis_id").alias("x")).select(*key, "x.*")
    setup = spark.createDataFrame([(1, NU0)], "chan int, nu double")
    rows, vis = open_files(spark, {path: setup for path in _written(once, folder)}, DNU, gap_scans(120.0))
    n = vis.groupBy("row_id").agg(F.count("*").alias("n_data"))
    return rows.join(n, "row_id").select("p", "q", "source", r("t", 3).alias("t"), "scan", "n_bands", "n_data")


def src_s6_eop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-column Earth orientation; rows without pole offsets are left out."""
    folder = _folder(spark)
    k = F.col("source_rawid")
    d = lambda x: F.when(k % 7 == 0, F.lit(" " * 9)).otherwise(F.format_string("%9.3f", x))
    gap = lambda n: F.lit(" " * n)
    line = F.concat(gap(7), F.format_string("%8.2f", (59000 + k).cast("double")), gap(3), F.format_string("%9.6f", k % 100 * 0.001), gap(10), F.format_string("%9.6f", k % 90 * 0.002), gap(12), F.format_string("%10.7f", (k % 50 - 25) * 0.01), gap(29), d((k % 9) * 0.1 - 0.4), gap(10), d((k % 8) * 0.1 - 0.3))
    table(spark, sf_dir, "sources").select("source_rawid").distinct().select(line.alias("value")).write.text(f"file://{folder}/eop")
    e = readers.read_eop(spark, f"file://{folder}/eop")
    return e.select(r("mjd", 2).alias("mjd"), r("xp", 6).alias("xp"), r("yp", 6).alias("yp"), r("ut1_utc", 7).alias("ut1_utc"), r(F.col("dx") * 1e12, 3).alias("dx"), r(F.col("dy") * 1e12, 3).alias("dy"))


def _tec_text(start_hour: int) -> str:
    """IONEX text of three maps half a day apart: 10 + epoch + 0.03 lat TECU, one value missing."""
    rows = ["     1.0            IONOSPHERE MAPS     GPS                 IONEX VERSION / TYPE", "  6371.0".ljust(60) + "BASE RADIUS", "   450.0 450.0   0.0".ljust(60) + "HGT1 / HGT2 / DHGT", "    -2".ljust(60) + "EXPONENT", "".ljust(60) + "END OF HEADER"]
    for kind in ("TEC", "RMS"):
        for n in range(3):
            day, hour = divmod(start_hour + 12 * n, 24)
            epoch = start_hour // 12 + n
            rows += [f"{n + 1:6d}".ljust(60) + f"START OF {kind} MAP", f"  2024     1{day + 1:6d}{hour:6d}     0     0".ljust(60) + "EPOCH OF CURRENT MAP"]
            for lat in range(90, -91, -10):
                values = [9999 if kind == "TEC" and (epoch, lat, lon) == (1, 80, 0) else 1000 + 100 * epoch + 3 * lat if kind == "TEC" else 200 for lon in range(-180, 181, 20)]
                rows.append(f"  {lat:6.1f}{-180.0:6.1f}{180.0:6.1f}{20.0:6.1f}{450.0:6.1f}".ljust(60) + "LAT/LON1/LON2/DLON/H")
                rows += ["".join(f"{v:5d}" for v in values[a : a + 16]) for a in range(0, len(values), 16)]
            rows.append(f"{n + 1:6d}".ljust(60) + f"END OF {kind} MAP")
    return "\n".join(rows)


def _tec(spark: SparkSession) -> DataFrame:
    folder = _folder(spark)
    for name, hour in (("a.24i", 0), ("b.24i", 24)):  # the second begins with the map that the first ends with
        Path(f"{folder}/{name}").write_text(_tec_text(hour))
    return readers.read_tec_maps(spark, f"file://{folder}/*.24i")


def src_s7_tec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of two files, the shared epoch once."""
    ensure_utc(spark)
    return _tec(spark).select(r("mjd", 3).alias("mjd"), "lat", "lon", r("tec", 4).alias("tec"), r("rms", 4).alias("rms"), "base", "height")


def fn_f13_tec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical TEC at every source's declination, interpolated between the maps (which don't depend on the longitude)."""
    pdf = _tec(spark).toPandas()  # a map product has a fixed size
    pdf = pdf[pdf["lat"] < 75].sort_values(["mjd", "lat", "lon"])
    axes = [np.sort(pdf[c].unique()) for c in ("mjd", "lat", "lon")]
    cube = lambda c: pdf[c].to_numpy().reshape([len(a) for a in axes])
    maps = dm.TecMaps(*axes, cube("tec"), cube("rms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mjd = 60310 + (b["source_rawid"] % 100).to_numpy() / 50
            yield b.assign(tec=maps.vertical(mjd, b["lat"].to_numpy(), b["lon"].to_numpy()), rms=maps.uncertainty(mjd, b["lat"].to_numpy(), b["lon"].to_numpy()))

    rows = table(spark, sf_dir, "sources").select("source_rawid", F.greatest(F.least("dec_deg", F.lit(70.0)), F.lit(-90.0)).alias("lat"), F.col("ra_deg").alias("lon")).distinct()
    return rows.mapInPandas(run, "source_rawid int, lat double, lon double, tec double, rms double").select("source_rawid", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), r("tec", 8).alias("tec"), r("rms", 6).alias("rms"))


def src_s9_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable pressures only (the events' values stand for them)."""
    w = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("antenna_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.when(F.col("event_id") % 11 != 0, F.col("value")) * F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(1.0)).alias("pressure"))
    return readers.pressure_series(w).select("antenna_no", "t", r("pressure", 6).alias("pressure"))


def src_s10_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polynomials and clocks of one key in one row."""
    s = table(spark, sf_dir, "sources").select("source_rawid").distinct()
    key = [F.col("source_rawid").cast("double").alias("t"), (F.col("source_rawid") % 5).alias("antenna_no"), F.concat(F.lit("s"), F.col("source_rawid").cast("string")).alias("source")]
    got = readers.correlator_model(s.select(*key, F.array(F.col("source_rawid") * 0.5, F.lit(2.0)).alias("gdelay")), s.select(*key, (F.col("source_rawid") * 0.25).alias("clock")))
    return got.select("start", "antenna_no", "source", F.element_at("gdelay", 1).alias("g0"), F.element_at("gdelay", 2).alias("g1"), "clock")


def src_s12_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model file per source: components in polar form come back as offsets."""
    folder = _folder(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["source_rawid"]:
                Path(f"{folder}/S{k}_x.mod").write_text(f"! model of {k}\n{1 + k % 3}.5v 0.0v 0.0v\n0.25v {k % 7}.0v {k % 360}.0v\n")
            yield b

    table(spark, sf_dir, "sources").select("source_rawid").distinct().mapInPandas(write, "source_rawid int").count()
    m = readers.read_models(spark, f"file://{folder}/*.mod")
    return m.select("source", r("flux", 6).alias("flux"), r("x", 6).alias("x"), r("y", 6).alias("y"), F.length("sha256").alias("digest"))


def src_s13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sources in the strict two-column form."""
    folder = _folder(spark)
    s = table(spark, sf_dir, "sources").where(F.col("name").rlike(r"^\S+$") & F.col("rfc_jname").rlike(r"^J\d{4}[+-]\d{3}[0-9A-Z]$"))
    rows = sorted((x[0], x[1]) for x in s.groupBy("name").agg(F.min("rfc_jname")).collect())  # the registry is a small fixed table
    Path(f"{folder}/names.tsv").write_text("source_name\trfc_jname\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
    return readers.read_source_names(spark, f"{folder}/names.tsv")


def src_s5_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions carried to an epoch from a geometry file."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "antennas").where("name IS NOT NULL").groupBy("name").agg(F.min("x_m").alias("x"), F.min("y_m").alias("y"), F.min("z_m").alias("z"), F.min("antenna_no").alias("n")).collect()  # a small fixed table
    tides = ", ".join(f'"{x}"' for x in dm.TIDES)
    text = f"tides = [{tides}]\n" + "".join(f"[antennas.{x['name']}]\nxyz = [{x['x']!r}, {x['y']!r}, {x['z']!r}]\nvelocity = [{x['n'] * 0.01!r}, -0.02, 0.0]\nepoch = 2020.0\nmount = \"altaz\"\naxis_offset = {x['n'] * 0.5!r}\n" for x in rows)
    Path(f"{folder}/g.toml").write_text(text)
    return readers.read_geometry(spark, f"{folder}/g.toml", 2024.5).select("code", r("x", 3).alias("x"), r("y", 3).alias("y"), r("z", 3).alias("z"), "axis_offset", F.size("amplitude").alias("n_amplitudes"))


def src_s14_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty visibilities of every baseline, time, channel and slot pair, one antenna with one receptor."""
    ensure_utc(spark)
    v = readers.simulate(spark, 5, [0.0, 1.0, 2.0], channels(spark), [2], 2.0)
    return v.groupBy("p", "q", "i", "j").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.countDistinct("row_id").alias("n_rows"), F.countDistinct("chan").alias("n_channels"))


def snk_k1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observables written as CSV and read again: numbers are the same to the last bit."""
    folder = _folder(spark)
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual"))).select("obs_id", "session", "a1", "a2", "t", "tau_residual", "snr")
    sinks.write_table(o, f"file://{folder}/t")
    return spark.read.csv(f"file://{folder}/t", header=True, schema="obs_id bigint, session string, a1 string, a2 string, t double, tau_residual double, snr double").select("obs_id", "session", "a1", "a2", "t", "tau_residual")


def snk_k2_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The antennas as a catalogue; the typed file's body read again, in its order."""
    folder = _folder(spark)
    a = table(spark, sf_dir, "antennas").where("name IS NOT NULL").groupBy("name").agg(F.min("antenna_no").alias("antenna_no"), F.min("x_m").alias("x_m"))
    path = sinks.write_catalogue(a, folder, {"x_m": "m"}, {"kind": "antennas"}, ["name"])[0]
    lines = spark.read.text(f"file://{path}", wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#"))).alias("place", "line")).where("place > 0")
    cells = F.split("line", ",")
    return lines.select("place", cells[0].alias("name"), cells[1].cast("int").alias("antenna_no"), cells[2].cast("double").alias("x_m"))


def snk_k3_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per session, written by tasks, copied under a new position, and read again."""
    folder = _folder(spark)
    k = F.substring("session", 3, 12).cast("int")
    images = table(spark, sf_dir, "sessions").select(F.col("session").alias("source"), F.lit(4).alias("npix"), F.lit(0.5).alias("pixel"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (j + k).cast("double")).alias("restored"), F.lit(10.0).alias("ra_deg"), F.lit(20.0).alias("dec_deg"), F.lit(1.0).alias("sigma_major"), F.lit(0.5).alias("ratio"), F.lit(0.1).alias("pa"))
    sinks.write_images(images, f"{folder}/images", "2024-01-01", ["made for a test"]).count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                copy = fits.registered_copy(bytes(raw), 11.0, -21.5, ["moved"])
                f = io.BytesIO(copy)
                h = fits.read_header(f)
                pixels = np.frombuffer(f.read(fits.data_bytes(h)), ">f4")
                out.append((Path(path).stem, int(h["NAXIS1"]), float(h["CRVAL1"]), float(h["CRVAL2"]), float(pixels.sum()), float(pixels[0]), len(copy) % 2880, h["HISTORY"][-1]))
            yield pd.DataFrame(out, columns=["source", "naxis1", "ra", "dec", "total", "first_pixel", "rest", "note"])

    found = spark.read.format("binaryFile").load(f"file://{folder}/images/*.fits").select("path", "content")
    return found.mapInPandas(read, "source string, naxis1 int, ra double, dec double, total double, first_pixel double, rest int, note string")


def snk_k7_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all sessions, and the manifest of the folder with its digest."""
    folder = _folder(spark)
    s = table(spark, sf_dir, "sessions").select("session", "n_antennas").orderBy("session")
    sinks.write_report(folder, "Sessions", {"made": "for a test"}, {"sessions": s})
    sinks.write_manifest(folder, {"reference": "A1"})
    lines = spark.read.text([f"file://{folder}/report.md", f"file://{folder}/manifest.toml"])
    kind = F.when(F.col("value").rlike(r"^\| vx"), "row").when(F.col("value").rlike(r'^"report.md" = "[0-9a-f]{64}"$'), "digest").when(F.col("value") == 'reference = "A1"', "setting")
    return lines.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (src_s1_fits, src_s2_files, src_s5_geometry, src_s6_eop, src_s7_tec, fn_f13_tec, src_s9_pressure, src_s10_model, src_s12_models, src_s13_names, src_s14_simulate, snk_k1_table, snk_k2_catalogue, snk_k3_images, snk_k7_manifest)}

_POLE = repr(math.radians(1 / 3600) * 1e-3 * 1e12) + "::DOUBLE"
_MAPS = "e AS (SELECT x e, 60310 + x * 0.5e0 mjd FROM range(5) r(x)), la AS (SELECT x * 10e0 lat FROM range(-9, 10) r(x)), lo AS (SELECT x * 20e0 lon FROM range(-9, 10) r(x))"

ORACLE = {
    "src_s1_fits": f"""
SELECT p, q, coalesce(source_ix, 0) AS source_ix, round((epoch_us(datetime) - {DAY0_US}) / 1e6, 3) + 0 AS t, round(u_m, 3) + 0 AS u_m, round(int_time, 3) + 0 AS int_time,
  round(CASE WHEN coalesce(CAST(vis_re AS VARCHAR), 'nan') = 'nan' THEN 0 ELSE vis_re END, 6) + 0 AS re, round(CASE WHEN coalesce(CAST(vis_im AS VARCHAR), 'nan') = 'nan' THEN 0 ELSE vis_im END, 6) + 0 AS im, round(greatest(weight, 0), 6) + 0 AS w FROM dataset WHERE p <> q""",
    "src_s2_files": f"""
WITH d AS (SELECT DISTINCT p, q, coalesce(source_ix, 0) source, (epoch_us(datetime) - {DAY0_US}) / 1e6 t FROM dataset WHERE p <> q), s AS (SELECT DISTINCT t, source FROM d),
b AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 120 OR source <> lag(source) OVER w THEN 1 ELSE 0 END n FROM s WINDOW w AS (ORDER BY t, source)),
c AS (SELECT t, source, CAST(sum(n) OVER (ORDER BY t, source) AS INT) scan FROM b)
SELECT p, q, source, round(t, 3) + 0 AS t, scan, 1 AS n_bands, 1 AS n_data FROM d JOIN c USING (t, source)""",
    "src_s5_geometry": "SELECT name AS code, round(min(x_m) + min(antenna_no) * 0.01e0 * 4.5e0, 3) + 0 AS x, round(min(y_m) - 0.02e0 * 4.5e0, 3) + 0 AS y, round(min(z_m), 3) + 0 AS z, min(antenna_no) * 0.5e0 AS axis_offset, 33 AS n_amplitudes FROM antennas WHERE name IS NOT NULL GROUP BY name",
    "src_s6_eop": f"SELECT DISTINCT 59000 + source_rawid + 0e0 AS mjd, round(source_rawid % 100 * 0.001e0, 6) AS xp, round(source_rawid % 90 * 0.002e0, 6) AS yp, round((source_rawid % 50 - 25) * 0.01e0, 7) + 0 AS ut1_utc, round(((source_rawid % 9) * 0.1e0 - 0.4e0) * {_POLE}, 3) + 0 AS dx, round(((source_rawid % 8) * 0.1e0 - 0.3e0) * {_POLE}, 3) + 0 AS dy FROM sources WHERE source_rawid % 7 <> 0",
    "src_s7_tec": f"WITH {_MAPS} SELECT mjd, lat, lon, CASE WHEN e = 1 AND lat = 80 AND lon = 0 THEN NULL ELSE round(10 + e + 0.03e0 * lat, 4) END AS tec, 2e0 AS rms, 6371e3 AS base, 450e3 AS height FROM e, la, lo",
    "fn_f13_tec": "SELECT DISTINCT source_rawid, round(greatest(least(dec_deg, 70), -90), 6) + 0 AS lat, round(ra_deg, 6) + 0 AS lon, round(10 + least((source_rawid % 100) / 25e0, 4) + 0.03e0 * greatest(least(dec_deg, 70), -90), 8) + 0 AS tec, 2e0 AS rms FROM sources",
    "src_s9_pressure": "SELECT CAST(user_id % 10 AS INT) AS antenna_no, epoch_us(ts) AS t, round(value, 6) AS pressure FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND value > 100",
    "src_s10_model": "SELECT DISTINCT source_rawid + 0e0 AS start, source_rawid % 5 AS antenna_no, 's' || source_rawid AS source, source_rawid * 0.5e0 AS g0, 2e0 AS g1, source_rawid * 0.25e0 AS clock FROM sources",
    "src_s12_models": "WITH k AS (SELECT DISTINCT source_rawid k FROM sources) SELECT 'S' || k AS source, 1.5e0 + k % 3 AS flux, 0e0 AS x, 0e0 AS y, 64 AS digest FROM k UNION ALL SELECT 'S' || k, 0.25e0, round(k % 7 * sin(radians(k % 360)), 6) + 0, round(k % 7 * cos(radians(k % 360)), 6) + 0, 64 FROM k",
    "src_s13_names": r"SELECT name AS source_name, min(rfc_jname) AS rfc_jname FROM sources WHERE regexp_full_match(name, '\S+') AND regexp_full_match(rfc_jname, 'J\d{4}[+-]\d{3}[0-9A-Z]') GROUP BY name",
    "src_s14_simulate": "WITH a AS (SELECT CAST(x AS INT) x FROM range(1, 6) r(x)), s AS (SELECT CAST(x AS INT) x FROM range(1, 3) r(x)) SELECT p.x AS p, q.x AS q, i.x AS i, j.x AS j, 21 AS n, CASE WHEN (p.x = 2 AND i.x = 2) OR (q.x = 2 AND j.x = 2) THEN 0e0 ELSE 42e0 END AS w, 3 AS n_rows, 7 AS n_channels FROM a p JOIN a q ON p.x < q.x, s i, s j",
    "snk_k1_table": "SELECT obs_id, session, a1, a2, t, tau_residual FROM observables WHERE isfinite(tau_residual)",
    "snk_k2_catalogue": "SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS place, name, min(antenna_no) AS antenna_no, min(x_m) AS x_m FROM antennas WHERE name IS NOT NULL GROUP BY name",
    "snk_k3_images": "WITH k AS (SELECT session, CAST(substr(session, 3) AS INT) k FROM sessions) SELECT session AS source, 4 AS naxis1, 11e0 AS ra, -21.5e0 AS dec, 16 * k + 120e0 AS total, k + 3e0 AS first_pixel, 0 AS rest, 'moved' AS note FROM k",
    "snk_k7_manifest": "SELECT 'row' AS kind, count(*) AS n FROM sessions UNION ALL SELECT 'digest', 1 UNION ALL SELECT 'setting', 1",
}
