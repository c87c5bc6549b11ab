"""Scalar functions as Columns: mappings, times, text forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vislake.functions import delaymodel as dm

MAS = math.radians(1e-3 / 3600)


def at_time(time0: Column, t: Column) -> Column:
    """Timestamp of t seconds after time0."""
    return F.timestamp_micros(F.unix_micros(time0.cast("timestamp")) + F.rint(t * 1e6).cast("bigint"))


def _table(row: list[float], lat_deg: Column) -> Column:
    """Linear interpolation of a five-point literal table, held constant outside."""
    nodes = dm.NIELL_LAT.tolist()
    x = F.least(F.greatest(F.abs(lat_deg), F.lit(nodes[0])), F.lit(nodes[-1]))
    out = F.lit(row[-1])
    for k in reversed(range(4)):
        piece = F.lit(row[k]) + (x - nodes[k]) * ((row[k + 1] - row[k]) / (nodes[k + 1] - nodes[k]))
        out = F.when(x <= nodes[k + 1], piece).otherwise(out)
    return out


def _fraction(s: Column, a, b, c) -> Column:
    one = 1 + a / (1 + b / (1 + c))
    return one / (s + a / (s + b / (s + c)))


def wet_mapping(el: Column, lat: Column) -> Column:
    """Niell's wet mapping."""
    deg = F.degrees(lat)
    return _fraction(F.sin(el), *[_table(r.tolist(), deg) for r in dm.NIELL_WET])


def hydrostatic_mapping(el: Column, lat: Column, height: Column, doy: Column) -> Column:
    """Niell's hydrostatic mapping."""
    deg = F.degrees(lat)
    d = doy + F.when(deg < 0, 182.625).otherwise(0.0)
    year = F.cos((d - 28) * (2 * math.pi / 365.25))
    abc = [_table(m.tolist(), deg) - _table(a.tolist(), deg) * year for m, a in zip(dm.NIELL_DRY, dm.NIELL_DRY_AMP)]
    s = F.sin(el)
    return _fraction(s, *abc) + (1 / s - _fraction(s, *[F.lit(x) for x in dm.NIELL_HEIGHT])) * height / 1000


def gradient_mapping(el: Column) -> Column:
    """Gradient mapping."""
    return 1 / (F.sin(el) * F.tan(el) + 0.0032)


def zenith_hydrostatic(pressure: Column, lat: Column, height: Column) -> Column:
    """Zenith path in m."""
    return 0.0022768 * pressure / (1 - 0.00266 * F.cos(2 * lat) - 0.00028 * height / 1000)


def standard_pressure(height: Column) -> Column:
    """Standard atmosphere in hPa."""
    return 1013.25 * F.pow(1 - 2.25577e-5 * height, F.lit(5.2559))


def petrov_mapping(el_deg: Column, height: float, base: float) -> Column:
    """Modified single-layer mapping."""
    ratio = base / (base + height + dm.PETROV_DH)
    c = F.cos(F.radians(el_deg) * dm.PETROV_ALPHA) * ratio
    return dm.PETROV_K / F.sqrt(1 - c * c)


def single_layer_mapping(el_deg: Column, height: float, base: float) -> Column:
    """Single-layer mapping."""
    c = F.cos(F.radians(el_deg)) * (base / (base + height))
    return 1 / F.sqrt(1 - c * c)


def tec_delay(tecu: Column, nu_eff: Column) -> Column:
    """Group delay of a slant TEC in s."""
    return tecu * (dm.K_ION / dm.C_LIGHT * dm.TECU) / (nu_eff * nu_eff)


def uv_from_partials(d_ra: Column, d_dec: Column, nu: Column) -> tuple[Column, Column]:
    """uv in 1/mas from source partials."""
    s = -nu * MAS
    return d_ra * s, d_dec * s


def absolute_position(x: Column, y: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """(ra, dec) in rad of a map position in mas."""
    return ra + x * MAS / F.cos(dec), dec + y * MAS


def longitude_latitude(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Geodetic longitude and latitude in degrees, Bowring's closed form."""
    a, f = dm.EARTH_RADIUS, dm.FLATTENING
    b, e2 = a * (1 - f), f * (2 - f)
    p = F.hypot(x, y)
    u = F.atan2(z * a, p * b)
    s, c = F.sin(u), F.cos(u)
    lat = F.atan2(z + (e2 / (1 - e2) * b) * s * s * s, p - (e2 * a) * c * c * c)
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def _sexagesimal(value: Column, places: int) -> tuple[Column, Column, Column]:
    """Whole, minutes, seconds of a non-negative number, rounded so that 60 seconds carry over."""
    unit = 10**places
    total = F.rint(value * 3600 * unit).cast("bigint")
    whole = F.floor(total / (3600 * unit)).cast("bigint")
    minutes = F.floor((total - whole * 3600 * unit) / (60 * unit)).cast("bigint")
    return whole, minutes, (total - whole * 3600 * unit - minutes * 60 * unit) / unit


def ra_sexagesimal(ra: Column) -> Column:
    """Radians as 'hh mm ss.ssssss' (F22)."""
    h, m, s = _sexagesimal(F.pmod(F.degrees(ra), F.lit(360.0)) / 15, 6)
    return F.format_string("%02d %02d %09.6f", F.pmod(h, F.lit(24)), m, s)


def dec_sexagesimal(dec: Column) -> Column:
    """Radians as '+dd mm ss.sssss' (F22)."""
    d, m, s = _sexagesimal(F.abs(F.degrees(dec)), 5)
    return F.concat(F.when(dec < 0, "-").otherwise("+"), F.format_string("%02d %02d %08.5f", d, m, s))


def filled_template(pattern: str, source: Column, epoch: Column) -> Column:
    """A path template with {src} and {epoch} filled in."""
    return F.replace(F.replace(F.lit(pattern), F.lit("{src}"), source), F.lit("{epoch}"), epoch)


def slug(label: Column) -> Column:
    """Lower-case name of a model set for file names."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))


def product_label(poltypes1: Column, poltypes2: Column, i: Column, j: Column) -> Column:
    """Correlation label from the receptors of both ends; '?' where a slot has none."""
    return F.concat(F.coalesce(F.try_element_at(poltypes1, i), F.lit("?")), F.coalesce(F.try_element_at(poltypes2, j), F.lit("?")))


def without_term(columns: list[str], term: str, sign: float = -1.0) -> dict[str, Column]:
    """Columns with a term taken out of (or put back into) each."""
    return {c: F.col(c) + sign * F.col(term) for c in columns}


def matched_nan(value: Column, other: Column) -> Column:
    """NaN where the other table's value is NaN."""
    return F.when(F.isnan(other), F.lit(float("nan"))).otherwise(value)
