"""Readers of text and configuration inputs (S5-S10, S12-S14): Earth orientation, TEC maps, names, geometry, models."""

from __future__ import annotations

import gzip
import hashlib
import io
import lzma
import math
import re
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vislake.functions.delaymodel import TIDES
from vislake.session import bounded

_ARCSEC = math.radians(1 / 3600)


def read_eop(spark: SparkSession, path: str) -> DataFrame:
    """(mjd, xp, yp, ut1_utc, dx, dy) of a finals2000A file (S6): xp, yp in arcsec, ut1_utc in s, dx, dy in rad.

    Fixed columns; rows with a blank in any of the fields (predictions without pole offsets) are left out.
    """
    part = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    fields = {"mjd": (8, 15), "xp": (19, 27), "yp": (38, 46), "ut1_utc": (59, 68), "dx": (98, 106), "dy": (117, 125)}
    cut = spark.read.text(path).select(*[part(a, b).alias(c) for c, (a, b) in fields.items()])
    full = F.lit(True)
    for c in fields:
        full = full & (F.col(c) != "")
    d = cut.where(full).select(*[F.expr(f"try_cast({c} AS double)").alias(c) for c in fields])
    return d.select("mjd", "xp", "yp", "ut1_utc", (F.col("dx") * 1e-3 * _ARCSEC).alias("dx"), (F.col("dy") * 1e-3 * _ARCSEC).alias("dy"))


def _unpacked(path: str, raw: bytes) -> str:
    """Text of a plain, gz, xz or Z file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    elif raw[:6] == b"\xfd7zXZ\x00":
        raw = lzma.decompress(raw)
    elif raw[:2] == b"\x1f\x9d":
        raw = _uncompress(raw)
    return raw.decode("latin-1")


def _uncompress(raw: bytes) -> bytes:
    """The .Z format: codes of growing width, in groups of eight; 256 clears the table in block mode."""
    widest, block = raw[2] & 31, raw[2] & 128
    data, out, table = raw[3:], bytearray(), [bytes([k]) for k in range(256)] + ([b""] if block else [])
    width, at, last, start = 9, 0, None, 0
    while True:
        if at + width > 8 * len(data):
            return bytes(out)
        first = at // 8
        code = int.from_bytes(data[first : first + 4], "little") >> (at % 8) & ((1 << width) - 1)
        at += width
        if block and code == 256:
            at = start + -(-(at - start) // (8 * width)) * 8 * width
            table, width, last, start = table[:257], 9, None, at
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 1 << widest:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= 1 << width and width < widest:
            at = start + -(-(at - start) // (8 * width)) * 8 * width
            width, start = width + 1, at


def parse_tec(text: str) -> pd.DataFrame:
    """(mjd, lat, lon, tec, rms, base, height) of an IONEX text; 9999 is NaN, values times 10^exponent, TECU and m."""
    lines = text.splitlines()
    exponent, base, height = -1, 6371e3, 450e3
    rows: dict[tuple, list[float]] = {}
    kind, mjd, lat, lons, left = None, None, None, [], []
    for line in lines:
        label, body = line[60:].strip(), line[:60]
        if label == "EXPONENT":
            exponent = int(body)
        elif label == "BASE RADIUS":
            base = float(body) * 1e3
        elif label == "HGT1 / HGT2 / DHGT":
            height = float(body.split()[0]) * 1e3
        elif label in ("START OF TEC MAP", "START OF RMS MAP"):
            kind = label.split()[2]
        elif label in ("END OF TEC MAP", "END OF RMS MAP"):
            kind = None
        elif label == "EPOCH OF CURRENT MAP":
            y, m, d, hh, mm, ss = (float(x) for x in body.split())
            mjd = pd.Timestamp(int(y), int(m), int(d)).to_julian_date() - 2400000.5 + (hh * 3600 + mm * 60 + ss) / 86400
        elif label == "LAT/LON1/LON2/DLON/H":
            lat, a, b, step = (float(line[2 + 6 * k : 8 + 6 * k]) for k in range(4))
            lons = [a + step * k for k in range(int(round((b - a) / step)) + 1)]
            left = list(range(len(lons)))
        elif kind and left:
            for k in range(0, len(line.rstrip()), 5):
                if not left:
                    break
                v = int(line[k : k + 5])
                j = left.pop(0)
                rows.setdefault((mjd, lat, lons[j]), [math.nan, math.nan])[kind == "RMS"] = math.nan if v == 9999 else v * 10.0**exponent if exponent >= 0 else v / 10.0**-exponent
    out = [(m, la, lo, t, r, base, height) for (m, la, lo), (t, r) in rows.items()]
    return pd.DataFrame(out, columns=["mjd", "lat", "lon", "tec", "rms", "base", "height"])


def read_tec_maps(spark: SparkSession, path: str) -> DataFrame:
    """TEC maps of one or many files, each parsed by the task that holds it.

    The map that ends one day and starts the next comes out once (epochs within 1e-9 days are one, the first file by name
    wins).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                yield parse_tec(_unpacked(p, raw)).assign(path=p)

    kind = "mjd double, lat double, lon double, tec double, rms double, base double, height double, path string"
    maps = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kind)
    epoch = maps.select("path", "mjd").distinct().withColumn("gap", F.col("mjd") - F.lag("mjd").over(Window.orderBy("mjd", "path")))
    keep = epoch.where(F.col("gap").isNull() | (F.col("gap") > 1e-9)).select("path", "mjd")
    return maps.join(bounded(keep), ["path", "mjd"]).drop("path")


def pressure_series(weather: DataFrame, least: float = 100.0) -> DataFrame:
    """(antenna_no, t, pressure) of usable pressures in hPa (S9); weather: antenna_no, t, pressure."""
    return weather.where(F.coalesce(~F.isnan("pressure") & (F.col("pressure") > least), F.lit(False))).select("antenna_no", "t", "pressure")


def correlator_model(intervals: DataFrame, clocks: DataFrame) -> DataFrame:
    """Model polynomials and clocks joined on (t, antenna_no, source); a row without its partner is an error."""
    key = ["t", "antenna_no", "source"]
    full = intervals.join(clocks.withColumn("__there", F.lit(True)), key, "full")
    bad = F.col("__there").isNull() | F.col("gdelay").isNull()
    checked = F.when(bad, F.raise_error(F.lit("model and clock rows do not match"))).otherwise(F.col("t"))
    return full.select(checked.alias("start"), "antenna_no", "source", *[c for c in full.columns if c not in (*key, "__there")])


def read_geometry(spark: SparkSession, path: str, epoch: float) -> DataFrame:
    """Antenna positions at an epoch (decimal year) from a TOML file (S5): code, x, y, z, axis_offset, amplitude, phase.

    Only altitude-azimuth mounts; the file's tide columns must be the canonical eleven.
    """
    doc = tomllib.loads(Path(path).read_text())
    if tuple(doc.get("tides", TIDES)) != TIDES:
        raise ValueError(f"tides must be {TIDES}")
    rows = []
    for code, a in doc["antennas"].items():
        if a.get("mount", "altaz") != "altaz":
            raise ValueError(f"{code}: mount {a['mount']}")
        xyz = np.array(a["xyz"], float) + np.array(a.get("velocity", [0, 0, 0]), float) * (epoch - a.get("epoch", epoch))
        flat = lambda k: [float(x) for r in a.get(k, [[0.0] * 11] * 3) for x in r]
        rows.append((code, *map(float, xyz), float(a.get("axis_offset", 0.0)), flat("ocean_loading_amplitude"), flat("ocean_loading_phase")))
    return spark.createDataFrame(rows, "code string, x double, y double, z double, axis_offset double, amplitude array<double>, phase array<double>")


def read_source_names(spark: SparkSession, path: str) -> DataFrame:
    """(source_name, rfc_jname) of a strict two-column TSV: header, forms, unique and sorted names are checked."""
    lines = Path(path).read_text().split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if not lines or lines[0] != "source_name\trfc_jname":
        raise ValueError("header must be source_name<TAB>rfc_jname")
    rows = [tuple(x.split("\t")) for x in lines[1:]]
    for n, r in enumerate(rows, 2):
        if len(r) != 2 or not re.fullmatch(r"\S+", r[0]) or not re.fullmatch(r"J\d{4}[+-]\d{3}[0-9A-Z]", r[1]):
            raise ValueError(f"line {n}: {r}")
    names = [r[0] for r in rows]
    if not rows or len(set(names)) != len(names) or names != sorted(names):
        raise ValueError("names must be there, unique and sorted")
    return spark.createDataFrame(rows, "source_name string, rfc_jname string")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Components of '.mod' files (S12): path, sha256, source, flux (Jy), x, y (mas) from flux, radius, angle lines.

    Lines that start with '!' are comments; a 'v' behind a number marks a free parameter. Files without components have no
    rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, raw in zip(b["path"], b["content"]):
                digest = hashlib.sha256(raw).hexdigest()
                for line in raw.decode("latin-1").splitlines():
                    f = [x.rstrip("v") for x in line.split("!")[0].split()]
                    if len(f) >= 3:
                        flux, radius, angle = float(f[0]), float(f[1]), math.radians(float(f[2]))
                        out.append((p, digest, Path(p).name.split("_")[0].removesuffix(".mod"), flux, radius * math.sin(angle), radius * math.cos(angle)))
            yield pd.DataFrame(out, columns=["path", "sha256", "source", "flux", "x", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sha256 string, source string, flux double, x double, y double")


def external_models(spark: SparkSession, folder: str, sources: DataFrame, images: bool = True) -> tuple[DataFrame, DataFrame]:
    """(models, census) of other reductions' files of one folder (S12): models as of read_models.

    census: one row per source of `sources` (source): n_components, sha256 of the model file (NULL: no file, which is no
    error), and with images the source's '.fits' file: image_sha256, date_obs, object, naxis. Files are read by the tasks that
    hold them; only headers of images are parsed.
    """
    models = read_models(spark, f"{folder}/*.mod")
    found = models.groupBy("source").agg(F.count("*").alias("n_components"), F.min("sha256").alias("sha256"))
    census = sources.select("source").distinct().join(found, "source", "left").fillna(0, ["n_components"])
    if not images:
        return models, census
    from vislake.sources.fits import read_header

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, raw in zip(b["path"], b["content"]):
                h = read_header(io.BytesIO(raw)) or {}
                out.append((Path(p).name.split("_")[0].removesuffix(".fits"), hashlib.sha256(raw).hexdigest(), str(h.get("DATE-OBS", "")).strip() or None, str(h.get("OBJECT", "")).strip() or None, int(h.get("NAXIS1", 0))))
            yield pd.DataFrame(out, columns=["source", "image_sha256", "date_obs", "object", "naxis"])

    seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(folder).select("path", "content").mapInPandas(headers, "source string, image_sha256 string, date_obs string, object string, naxis int")
    one = seen.groupBy("source").agg(F.min(F.struct("image_sha256", "date_obs", "object", "naxis")).alias("i")).select("source", "i.*")
    return models, census.join(one, "source", "left")


def wrong_dates(census: DataFrame, expected: str, days: int = 1) -> DataFrame:
    """(source, date_obs) of images whose date differs from the session's by more than some days: a warning, no error."""
    d = F.abs(F.datediff(F.try_to_timestamp("date_obs"), F.to_timestamp(F.lit(expected))))
    return census.where(F.coalesce(d > days, F.lit(False))).select("source", "date_obs")


def with_coherency(vis: DataFrame, weight: Callable[[DataFrame], Column] | None = None, uvw: Callable[[DataFrame], tuple[Column, Column]] | None = None, coherency: Callable[[DataFrame], tuple[Column, Column]] | None = None) -> DataFrame:
    """Simulated rows with own weights, uv coordinates and values (X6): each a callable of the table that gives Columns. Products
    of weight 0 (missing receptors) keep it; a coherency of (re, im) sees the new u and v."""
    if uvw is not None:
        u, v = uvw(vis)
        vis = vis.withColumns({"u": u, "v": v})
    if weight is not None:
        vis = vis.withColumn("w", F.when(F.col("w") > 0, weight(vis)).otherwise(0.0))
    if coherency is not None:
        re, im = coherency(vis)
        vis = vis.withColumns({"re": re, "im": im})
    return vis


def simulate(spark: SparkSession, n_antennas: int, times: list[float], channels: DataFrame, single: list[int] | None = None, weight: float = 1.0, source: int = 1) -> DataFrame:
    """Zero visibilities of every baseline, time, channel and slot pair (S14); slot 2 of single-receptor antennas has weight 0.

    Grown from one range over (time, baseline), so it is made in parallel: literal lists are exploded, nothing is crossed.
    """
    n_b = n_antennas * (n_antennas - 1) // 2
    pairs = [(p, q) for p in range(1, n_antennas + 1) for q in range(p + 1, n_antennas + 1)]
    chans = [(r["chan"], r["nu"], r["if_id"]) for r in channels.orderBy("chan").collect()]  # the channel table
    base = spark.range(len(times) * n_b).withColumn("b", (F.col("id") % n_b).cast("int")).withColumn("k", F.floor(F.col("id") / n_b).cast("int"))
    lit = lambda rows, names: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    rows = base.select(F.col("id").alias("row_id"), F.element_at(lit(pairs, "pq"), F.col("b") + 1).alias("bl"), F.element_at(F.array(*[F.lit(float(t)) for t in times]), F.col("k") + 1).alias("t"))
    rows = rows.select("row_id", "bl.p", "bl.q", "t", F.explode(lit(chans, ("chan", "nu", "if_id"))).alias("c"))
    rows = rows.select("row_id", "p", "q", F.lit(source).alias("source"), F.lit(1).alias("scan"), "t", "c.chan", "c.nu", "c.if_id", F.explode(lit([(1, 1), (2, 1), (1, 2), (2, 2)], "ij")).alias("s"))
    lone = (F.col("p").isin(single or []) & (F.col("s.i") == 2)) | (F.col("q").isin(single or []) & (F.col("s.j") == 2))
    return rows.select("row_id", "p", "q", "source", "scan", "t", "chan", "nu", "if_id", "s.i", "s.j", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.when(lone, 0.0).otherwise(weight).alias("w"))
