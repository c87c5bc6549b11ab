"""A priori delays: Earth rotation, geometry, troposphere and ionosphere (F4-F15, F17-F19), vectorised over rows in NumPy.

Precession-nutation has the largest terms of the public IAU 2006/2000A development (about 3 mas, or a full table given as a
parameter), Sun and Moon are low-precision series (about 10 arcsec and 0.3 degrees), planets go by mean elements. Solid tides
have both steps of the conventions. See the README for what that means in picoseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Constants of the IERS Conventions (2010), in SI units.
C_LIGHT = 299_792_458.0
AU = 1.49597870700e11
GM_SUN, GM_EARTH, GM_MOON = 1.32712440041e20, 3.986004418e14, 4.9028000e12
OMEGA_EARTH = 7.292115146706979e-5
EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
DAY = 86400.0
ARCSEC = np.radians(1 / 3600)
MAS = ARCSEC / 1000
TECU = 1e16
K_ION = 40.308

# MJD from which TAI - UTC is 10, 11, 12 ... seconds (IERS Bulletin C).
LEAP_MJD = np.array([41317, 41499, 41683, 42048, 42413, 42778, 43144, 43509, 43874, 44239, 44786, 45151, 45516, 46247, 47161, 47892, 48257, 48804, 49169, 49534, 50083, 50630, 51179, 53736, 54832, 56109, 57204, 57754])

# Niell (1996), rows a, b, c at latitudes 15, 30, 45, 60, 75 degrees.
NIELL_LAT = np.array([15.0, 30.0, 45.0, 60.0, 75.0])
NIELL_DRY = np.array([[1.2769934e-3, 1.2683230e-3, 1.2465397e-3, 1.2196049e-3, 1.2045996e-3], [2.9153695e-3, 2.9152299e-3, 2.9288445e-3, 2.9022565e-3, 2.9024912e-3], [62.610505e-3, 62.837393e-3, 63.721774e-3, 63.824265e-3, 64.258455e-3]])
NIELL_DRY_AMP = np.array([[0.0, 1.2709626e-5, 2.6523662e-5, 3.4000452e-5, 4.1202191e-5], [0.0, 2.1414979e-5, 3.0160779e-5, 7.2562722e-5, 11.723375e-5], [0.0, 9.0128400e-5, 4.3497037e-5, 84.795348e-5, 170.37206e-5]])
NIELL_HEIGHT = (2.53e-5, 5.49e-3, 1.14e-3)
NIELL_WET = np.array([[5.8021897e-4, 5.6794847e-4, 5.8118019e-4, 5.9727542e-4, 6.1641693e-4], [1.4275268e-3, 1.5138625e-3, 1.4572752e-3, 1.5007428e-3, 1.7599082e-3], [4.3472961e-2, 4.6729510e-2, 4.3908931e-2, 4.4626982e-2, 5.4736038e-2]])
# Modified single-layer mapping (Petrov 2023).
PETROV_ALPHA, PETROV_K, PETROV_DH = 0.9782, 0.85, 56.7e3


def tai_minus_utc(mjd: np.ndarray) -> np.ndarray:
    """Leap seconds at a UTC MJD from 1972 on."""
    return 9.0 + np.searchsorted(LEAP_MJD, np.asarray(mjd, float), "right")


def split_mjd(mjd0: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(day, fraction) of seconds after an MJD; the split keeps picoseconds of rotation."""
    whole = np.floor(mjd0)
    frac = (mjd0 - whole) + np.asarray(t, float) / DAY
    extra = np.floor(frac)
    return whole + extra, frac - extra


def geodetic(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longitude, latitude, height) on the WGS84 ellipsoid by fixed-point iteration."""
    x, y, z = np.moveaxis(np.asarray(xyz, float), -1, 0)
    e2, p = FLATTENING * (2 - FLATTENING), np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(8):
        n = EARTH_RADIUS / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e2 * n * np.sin(lat), p)
    n = EARTH_RADIUS / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    height = np.where(np.abs(np.cos(lat)) > 1e-6, p / np.maximum(np.cos(lat), 1e-12) - n, np.abs(z) - n * (1 - e2))
    return np.arctan2(y, x), lat, height


def fundamental(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Delaunay arguments l, l', F, D, Omega in radians; t in Julian centuries of TT from J2000."""
    deg = (134.96340251 + 477198.8675605 * t, 357.52910918 + 35999.0502911 * t, 93.27209062 + 483202.0174577 * t, 297.85019547 + 445267.1114469 * t, 125.04455501 - 1934.1362619 * t)
    return tuple(np.radians(d % 360) for d in deg)


# Largest terms of the pole's coordinates: multipliers of l, l', F, D, Omega; sine of X, cosine of Y (arcsec).
_NUTATION = np.array([
    (0, 0, 0, 0, 1, -6.844318, 9.205236), (0, 0, 2, -2, 2, -0.523908, 0.573033), (0, 0, 2, 0, 2, -0.090552, 0.097847), (0, 0, 0, 0, 2, 0.082169, -0.089618), (0, 1, 0, 0, 0, 0.058707, 0.007387),
    (1, 0, 0, 0, 0, 0.028288, -0.000675), (0, 1, 2, -2, 2, -0.020558, 0.022438), (0, 0, 2, 0, 1, -0.015407, 0.020070), (1, 0, 2, 0, 2, -0.011992, 0.012902), (0, -1, 2, -2, 2, 0.008585, -0.009593),
])


# The largest luni-solar terms of the IAU 2000 nutation: multiples of l, l', F, D, Omega, then the sine of the
# longitude, its rate per century and the cosine of the obliquity, in 0.1 microarcseconds.
NUTATION = np.array([
    (0, 0, 0, 0, 1, -172064161, -174666, 92052331), (0, 0, 2, -2, 2, -13170906, -1675, 5730336), (0, 0, 2, 0, 2, -2276413, -234, 978459), (0, 0, 0, 0, 2, 2074554, 207, -897492),
    (0, 1, 0, 0, 0, 1475877, -3633, 73871), (0, 1, 2, -2, 2, -516821, 1226, 224386), (1, 0, 0, 0, 0, 711159, 73, -6750), (0, 0, 2, 0, 1, -387298, -367, 200728),
    (1, 0, 2, 0, 2, -301461, -36, 129025), (0, -1, 2, -2, 2, 215829, -494, -95929), (0, 0, 2, -2, 1, 128227, 137, -68982), (-1, 0, 2, 0, 2, 123457, 11, -53311),
    (-1, 0, 0, 2, 0, 156994, 10, -1235), (1, 0, 0, 0, 1, 63110, 63, -33228), (-1, 0, 0, 0, 1, -57976, -63, 31429), (-1, 0, 2, 2, 2, -59641, -11, 25543),
    (1, 0, 2, 0, 1, -51613, -42, 26366), (-2, 0, 2, 0, 1, 45893, 50, -24236), (0, 0, 0, 2, 0, 63384, 11, -1220), (0, 0, 2, 2, 2, -38571, -1, 16452),
    (0, -2, 2, -2, 2, 32481, 0, -13870), (-2, 0, 0, 2, 0, -47722, 0, 477), (2, 0, 2, 0, 2, -31046, -1, 13238), (1, 0, 2, -2, 2, 28593, 0, -12338),
], float)
#: The same terms' cosine of the longitude and sine of the obliquity where they matter: row -> (longitude, obliquity).
NUTATION_OUT = {0: (33386.0, 15377.0), 1: (-13696.0, -4587.0), 2: (2796.0, 1374.0), 4: (11817.0, -1924.0)}


def pole(t: np.ndarray, series: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X and Y of the celestial pole in rad at TT centuries (F5): IAU 2006 precession in Fukushima-Williams angles with the
    largest nutation terms (about 3 mas). series: rows as of NUTATION for as many terms as wanted (from a public table)."""
    t = np.asarray(t, float)
    n = NUTATION if series is None else np.asarray(series, float)
    arg = np.stack(fundamental(t), -1) @ n[:, :5].T
    sin, cos = np.sin(arg), np.cos(arg)
    psi = (sin * (n[:, 5] + n[:, 6] * t[..., None])).sum(-1)
    eps = (cos * n[:, 7]).sum(-1)
    if series is None:
        for k, (a, b) in NUTATION_OUT.items():
            psi, eps = psi + a * cos[..., k], eps + b * sin[..., k]
    unit = ARCSEC * 1e-7
    poly = lambda *c: np.polyval(c[::-1], t) * ARCSEC
    gamma, phi = poly(-0.052928, 10.556378, 0.4932044, -0.00031238), poly(84381.412819, -46.811016, 0.0511268, 0.00053289)
    psi = poly(-0.041775, 5038.481484, 1.5584175, -0.00018522) + psi * unit - 0.135e-3 * ARCSEC
    eps = poly(84381.406, -46.836769, -0.0001831, 0.00200340) + eps * unit + 0.388e-3 * ARCSEC
    m = _rot(1, -eps) @ _rot(3, -psi) @ _rot(1, phi) @ _rot(3, gamma)
    return m[..., 2, 0], m[..., 2, 1]


def _rot(axis: int, angle: np.ndarray) -> np.ndarray:
    c, s, o, z = np.cos(angle), np.sin(angle), np.ones_like(angle), np.zeros_like(angle)
    m = {1: [[o, z, z], [z, c, s], [z, -s, c]], 2: [[c, z, -s], [z, o, z], [s, z, c]], 3: [[c, s, z], [-s, c, z], [z, z, o]]}[axis]
    return np.moveaxis(np.array(m), -1, 0)


def celestial_to_terrestrial(day: np.ndarray, frac: np.ndarray, ut1_utc: np.ndarray, xp: np.ndarray, yp: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Rotation matrices GCRS -> ITRS (F5): pole with offsets dx, dy (rad), rotation angle from UT1, polar motion (arcsec)."""
    day, frac, ut1_utc, xp, yp, dx, dy = np.broadcast_arrays(*(np.atleast_1d(np.asarray(a, float)) for a in (day, frac, ut1_utc, xp, yp, dx, dy)))
    tt = (day - 51544.5 + frac + (tai_minus_utc(day + frac) + 32.184) / DAY) / 36525
    x, y = pole(tt)
    x, y = x + dx, y + dy
    s = -x * y / 2 + (94 + 3808.65 * tt) * 1e-6 * ARCSEC - 2640.73e-6 * ARCSEC * np.sin(fundamental(tt)[4])
    r2 = x * x + y * y
    e, d = np.where(r2 > 0, np.arctan2(y, x), 0.0), np.arctan(np.sqrt(r2 / (1 - r2)))
    q = _rot(3, -(e + s)) @ _rot(2, d) @ _rot(3, e)
    whole, part = day - 51544.5, frac + ut1_utc / DAY
    turns = 0.7790572732640 + 0.00273781191135448 * (whole + part) + (whole % 1) + (part % 1)
    era = 2 * np.pi * (turns % 1)
    sp = -47e-6 * tt * ARCSEC
    w = _rot(1, -yp * ARCSEC) @ _rot(2, -xp * ARCSEC) @ _rot(3, sp)
    return w @ _rot(3, era) @ q


def sun_position(tt_mjd: np.ndarray) -> np.ndarray:
    """Geocentric Sun in m, equator of date (low precision)."""
    n = np.asarray(tt_mjd, float) - 51544.5
    g, lon0 = np.radians((357.528 + 0.9856003 * n) % 360), (280.460 + 0.9856474 * n) % 360
    lon = np.radians(lon0 + 1.915 * np.sin(g) + 0.020 * np.sin(2 * g))
    r, eps = (1.00014 - 0.01671 * np.cos(g) - 0.00014 * np.cos(2 * g)) * AU, np.radians(23.439 - 4e-7 * n)
    return np.stack([r * np.cos(lon), r * np.cos(eps) * np.sin(lon), r * np.sin(eps) * np.sin(lon)], -1)


def moon_position(tt_mjd: np.ndarray) -> np.ndarray:
    """Geocentric Moon in m, equator of date (low precision)."""
    t = (np.asarray(tt_mjd, float) - 51544.5) / 36525
    s = lambda a, b: np.sin(np.radians(a + b * t))
    lon = np.radians(218.32 + 481267.883 * t + 6.29 * s(134.9, 477198.85) - 1.27 * s(259.2, -413335.38) + 0.66 * s(235.7, 890534.23) + 0.21 * s(269.9, 954397.70) - 0.19 * s(357.5, 35999.05) - 0.11 * s(186.6, 966404.05))
    lat = np.radians(5.13 * s(93.3, 483202.03) + 0.28 * s(228.2, 960400.87) - 0.28 * s(318.3, 6003.18) - 0.17 * s(217.6, -407332.20))
    c = lambda a, b: np.cos(np.radians(a + b * t))
    par = np.radians(0.9508 + 0.0518 * c(134.9, 477198.85) + 0.0095 * c(259.2, -413335.38) + 0.0078 * c(235.7, 890534.23) + 0.0028 * c(269.9, 954397.70))
    r, eps = EARTH_RADIUS / np.sin(par), np.radians(23.439 - 0.0130042 * t)
    x, y, z = np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)
    return r[..., None] * np.stack([x, np.cos(eps) * y - np.sin(eps) * z, np.sin(eps) * y + np.cos(eps) * z], -1)


def earth_velocity(tt_mjd: np.ndarray) -> np.ndarray:
    """Barycentric velocity of the Earth in m/s: minus the Sun's motion around it (the Sun's own 12 m/s left out)."""
    h = 0.05
    return -(sun_position(np.asarray(tt_mjd) + h) - sun_position(np.asarray(tt_mjd) - h)) / (2 * h * DAY)


# Elements of the planets at J2000 and their rates per century (a in au, e, inclination, mean longitude, longitude
# of perihelion, node in degrees; public approximate elements for 1800 to 2050), and GM in SI units.
PLANETS = {
    "mercury": (2.2032e13, (0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (3.7e-7, 1.906e-5, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": (3.24858592e14, (0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (3.9e-6, -4.107e-5, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "mars": (4.282837e13, (1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (1.847e-5, 7.882e-5, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": (1.26712764e17, (5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-1.1607e-4, -1.3253e-4, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": (3.7940585e16, (9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-1.2506e-3, -5.0991e-4, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": (5.794556e15, (19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-1.96176e-3, -4.397e-5, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": (6.836527e15, (30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (2.6291e-4, 5.105e-5, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}


def planet_position(name: str, tt_mjd: np.ndarray) -> np.ndarray:
    """Heliocentric place in m, equator of J2000, from mean elements (some arcminutes; for gravitational delays)."""
    t = (np.asarray(tt_mjd, float) - 51544.5) / 36525
    a, e, inc, lon, peri, node = (x + r * t for x, r in zip(*PLANETS[name][1:]))
    m = np.radians((lon - peri + 180) % 360 - 180)
    ecc = m + e * np.sin(m)
    for _ in range(8):
        ecc = ecc - (ecc - e * np.sin(ecc) - m) / (1 - e * np.cos(ecc))
    flat = np.stack([a * (np.cos(ecc) - e), a * np.sqrt(1 - e * e) * np.sin(ecc), np.zeros_like(m)], -1) * AU
    turn = _rot(1, np.full_like(m, -np.radians(23.43928))) @ _rot(3, -np.radians(node)) @ _rot(1, -np.radians(inc)) @ _rot(3, -np.radians(peri - node))
    return np.einsum("...ij,...j->...i", turn, flat)


# Frequency dependence of the solid tides (IERS Conventions 2010, tables 7.3a and 7.3b), in mm. Diurnal: multiples
# of s, h, p, N', ps beside tau, then radial in and out of phase, transverse in and out of phase; terms of 0.04 mm and more
# (those left out are 0.02 mm or less each). Long-period: the same multiples, then radial and transverse in phase, then out.
TIDE_DIURNAL = np.array([
    (-2, 0, 1, 0, 0, -0.08, 0.00, -0.01, 0.01), (-1, 0, 0, -1, 0, -0.10, 0.00, 0.00, 0.00), (-1, 0, 0, 0, 0, -0.51, 0.00, -0.02, 0.03), (0, 0, 1, 0, 0, 0.06, 0.00, 0.00, 0.00), (1, -3, 0, 0, 1, -0.06, 0.00, 0.00, 0.00),
    (1, -2, 0, 0, 0, -1.23, -0.07, 0.06, 0.01), (1, -1, 0, 0, 1, 0.04, 0.00, 0.00, 0.00), (1, 0, 0, -1, 0, -0.22, 0.01, 0.01, 0.00), (1, 0, 0, 0, 0, 12.00, -0.80, -0.67, -0.03), (1, 0, 0, 1, 0, 1.73, -0.12, -0.10, 0.00),
    (1, 0, 0, 2, 0, -0.04, 0.00, 0.00, 0.00), (1, 1, 0, 0, -1, -0.50, -0.01, 0.03, 0.00), (1, 2, 0, 0, 0, -0.11, 0.01, 0.01, 0.00),
])
TIDE_LONG = np.array([(0, 0, 0, 1, 0, 0.47, 0.23, 0.16, 0.07), (0, 2, 0, 0, 0, -0.20, -0.12, -0.11, -0.05), (1, 0, -1, 0, 0, -0.11, -0.08, -0.09, -0.04), (2, 0, 0, 0, 0, -0.13, -0.11, -0.15, -0.07), (2, 0, 0, 1, 0, -0.05, -0.05, -0.06, -0.03)])


def _geocentric(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longitude, geocentric latitude, distance)."""
    return np.arctan2(xyz[..., 1], xyz[..., 0]), np.arctan2(xyz[..., 2], np.hypot(xyz[..., 0], xyz[..., 1])), np.linalg.norm(xyz, axis=-1)


def solid_tide(xyz: np.ndarray, body: np.ndarray, gm: float) -> np.ndarray:
    """Displacement in m by one body (F6, step 1): degree 2 with latitude-dependent Love numbers, degree 3, the parts out of
    phase and the latitude dependence of the diurnal and semidiurnal bands. xyz and body in the Earth-fixed frame."""
    lon, lat, r = _geocentric(xyz)
    b_lon, b_lat, d = _geocentric(body)
    u, b = xyz / r[..., None], body / d[..., None]
    c = (u * b).sum(-1, keepdims=True)
    p2 = (3 * np.sin(lat)[..., None] ** 2 - 1) / 2
    h2, l2, h3, l3 = 0.6078 - 0.0006 * p2, 0.0847 + 0.0002 * p2, 0.292, 0.015
    re = 6378136.6
    f2, f3 = gm / GM_EARTH * re**4 / d**3, gm / GM_EARTH * re**5 / d**4
    side = b - c * u
    out = f2[..., None] * (h2 * u * (1.5 * c * c - 0.5) + 3 * l2 * c * side) + f3[..., None] * (h3 * u * (2.5 * c**3 - 1.5 * c) + l3 * (7.5 * c * c - 1.5) * side)
    one, two = np.sin(2 * b_lat) / 2, np.cos(b_lat) ** 2  # strength of the diurnal and of the semidiurnal band
    sin, cos = np.sin(lat), np.cos(lat)
    s1, c1, s2, c2 = np.sin(lon - b_lon), np.cos(lon - b_lon), np.sin(2 * (lon - b_lon)), np.cos(2 * (lon - b_lon))
    radial = 3 * 0.0025 * sin * cos * one * s1 + 0.75 * 0.0022 * cos**2 * two * s2
    north = 3 * 0.0007 * np.cos(2 * lat) * one * s1 - 1.5 * 0.0007 * sin * cos * two * s2 - 3 * 0.0012 * sin**2 * one * c1 - 1.5 * 0.0024 * sin * cos * two * c2
    east = 3 * 0.0007 * sin * one * c1 + 1.5 * 0.0007 * cos * two * c2 + 3 * 0.0012 * sin * np.cos(2 * lat) * one * s1 - 1.5 * 0.0024 * sin**2 * cos * two * s2
    up_, east_, north_ = _local(lon, lat)
    return out + f2[..., None] * (radial[..., None] * up_ + north[..., None] * north_ + east[..., None] * east_)


def solid_tide_bands(xyz: np.ndarray, mjd_utc: np.ndarray) -> np.ndarray:
    """Displacement in m by the frequency dependence of the Love numbers (F6, step 2): diurnal and long-period tides."""
    mjd = np.asarray(mjd_utc, float)
    lon, lat, _ = _geocentric(xyz)
    t = (mjd - 51544.5 + (tai_minus_utc(mjd) + 32.184) / DAY) / 36525
    poly = lambda *c: np.polyval(c[::-1], t)
    s = poly(218.31664563, 481267.88194, -0.0014663889, 0.00000185139)
    tau = (mjd % 1) * 360 + poly(280.4606184, 36000.7700536, 0.00038793, -0.0000000258) - s
    s = s + poly(0, 1.396971278, 0.000308889, 0.000000021, 0.000000007)
    h = poly(280.46645, 36000.7697489, 0.00030322222, 0.000000020, -0.00000000654)
    p = poly(83.35324312, 4069.01363525, -0.01032172222, -0.0000124991, 0.00000005263)
    n = poly(234.95544499, 1934.13626197, -0.00207561111, -0.00000213944, 0.00000001650)
    ps = poly(282.93734098, 1.71945766667, 0.00045688889, -0.00000001778, -0.00000000334)
    slow = np.stack([s, h, p, n, ps], -1)
    sin, cos = np.sin(lat), np.cos(lat)
    a = np.radians(tau[..., None] + slow @ TIDE_DIURNAL[:, :5].T) + lon[..., None]
    sa, ca = np.sin(a), np.cos(a)
    r_in, r_out, t_in, t_out = TIDE_DIURNAL[:, 5:].T
    radial, north, east = (r_in * sa + r_out * ca).sum(-1) * 2 * sin * cos, (t_in * sa + t_out * ca).sum(-1) * np.cos(2 * lat), (t_in * ca - t_out * sa).sum(-1) * sin
    a = np.radians(slow @ TIDE_LONG[:, :5].T)
    r_in, t_in, r_out, t_out = TIDE_LONG[:, 5:].T
    radial = radial + (r_in * np.cos(a) + r_out * np.sin(a)).sum(-1) * (3 * sin**2 - 1) / 2
    north = north + (t_in * np.cos(a) + t_out * np.sin(a)).sum(-1) * 2 * sin * cos
    up_, east_, north_ = _local(lon, lat)
    return (radial[..., None] * up_ + north[..., None] * north_ + east[..., None] * east_) / 1000


def mean_pole(mjd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Secular pole in arcsec (IERS 2018)."""
    t = (np.asarray(mjd, float) - 51544.5) / 365.25
    return 0.0550 + 0.001677 * t, 0.3205 + 0.003460 * t


def _local(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors up, east, north."""
    up = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
    east = np.stack([-np.sin(lon), np.cos(lon), np.zeros_like(lon)], -1)
    return up, east, np.cross(up, east)


def pole_tide(lon: np.ndarray, lat: np.ndarray, xp: np.ndarray, yp: np.ndarray, mjd: np.ndarray) -> np.ndarray:
    """Displacement in m by polar motion about the secular pole."""
    mx, my = mean_pole(mjd)
    m1, m2 = xp - mx, -(yp - my)
    up, east, north = _local(lon, lat)
    co = np.pi / 2 - lat
    a, b = m1 * np.cos(lon) + m2 * np.sin(lon), m1 * np.sin(lon) - m2 * np.cos(lon)
    return (-0.033 * np.sin(2 * co) * a)[..., None] * up + (0.009 * np.cos(2 * co) * a)[..., None] * north + (0.009 * np.cos(co) * b)[..., None] * east


# Tides of ocean loading tables and their multipliers of tau, s, h, p, N', p_s.
TIDES = ("M2", "S2", "N2", "K2", "K1", "O1", "P1", "Q1", "MF", "MM", "SSA")
DOODSON = np.array([(2, 0, 0, 0, 0, 0), (2, 2, -2, 0, 0, 0), (2, -1, 0, 1, 0, 0), (2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (1, -1, 0, 0, 0, 0), (1, 1, -2, 0, 0, 0), (1, -2, 0, 1, 0, 0), (0, 2, 0, 0, 0, 0), (0, 1, 0, -1, 0, 0), (0, 0, 2, 0, 0, 0)])
_TIDE_PHASE = np.array([0, 0, 0, 0, 90, -90, -90, -90, 0, 0, 0])


def ocean_loading(amplitude: np.ndarray, phase_deg: np.ndarray, lon: np.ndarray, lat: np.ndarray, mjd: np.ndarray, gmst_deg: np.ndarray) -> np.ndarray:
    """Displacement in m from radial, west and south amplitudes (m) and phases (degrees) of eleven tides (F8)."""
    t = (np.asarray(mjd, float) - 51544.5) / 36525
    s, h, p, n, ps = 218.3164477 + 481267.88123 * t, 280.46646 + 36000.76983 * t, 83.35324 + 4069.01373 * t, 125.04452 - 1934.13626 * t, 282.93735 + 1.71946 * t
    tau = gmst_deg + 180 - s
    arg = np.tensordot(np.stack([tau, s, h, p, -n, ps], -1), DOODSON.T, 1) + _TIDE_PHASE
    d = (amplitude * np.cos(np.radians(arg[..., None, :] - phase_deg))).sum(-1)
    up, east, north = _local(lon, lat)
    return d[..., :1] * up - d[..., 1:2] * east - d[..., 2:3] * north


@dataclass(frozen=True)
class Terms:
    """Which contributions enter the geometric delay."""

    aberration: bool = True
    solid_tides: bool = True
    pole_tide: bool = True
    ocean_loading: bool = True
    gravitation: bool = True
    axis_offset: bool = True


@dataclass(frozen=True)
class Station:
    """Geocentric position in m and local properties of an antenna."""

    xyz: np.ndarray
    axis_offset: float = 0.0
    loading_amplitude: np.ndarray = field(default_factory=lambda: np.zeros((3, 11)))
    loading_phase: np.ndarray = field(default_factory=lambda: np.zeros((3, 11)))


def geometric_delay(station: Station, ra: np.ndarray, dec: np.ndarray, day: np.ndarray, frac: np.ndarray, eop: dict[str, np.ndarray], terms: Terms = Terms()) -> dict[str, np.ndarray]:
    """Delay of a plane wave at the antenna against the geocentre: tau, el, az and partials by (ra cos dec, dec).

    Negative when the source is up. eop: ut1_utc (s), xp, yp (arcsec), dx, dy (rad), per row. Rows are independent.
    """
    ra, dec, day, frac = np.broadcast_arrays(*(np.atleast_1d(np.asarray(a, float)) for a in (ra, dec, day, frac)))
    e = {k: np.broadcast_to(np.asarray(v, float), ra.shape) for k, v in eop.items()}
    rot = celestial_to_terrestrial(day, frac, e["ut1_utc"], e["xp"], e["yp"], e["dx"], e["dy"])
    mjd = day + frac
    tt = mjd + (tai_minus_utc(mjd) + 32.184) / DAY
    lon, lat, _ = geodetic(station.xyz)
    lon, lat = np.full(ra.shape, lon), np.full(ra.shape, lat)
    dot = lambda a, b: (a * b).sum(-1)
    sun, moon = sun_position(tt), moon_position(tt)
    v = earth_velocity(tt) if terms.aberration else np.zeros((*ra.shape, 3))
    place = np.broadcast_to(station.xyz, (*ra.shape, 3)).astype(float)
    shift = np.zeros_like(place)
    if terms.solid_tides:
        for body, gm in ((sun, GM_SUN), (moon, GM_MOON)):
            shift = shift + solid_tide(place, np.einsum("nij,nj->ni", rot, body), gm)
        shift = shift + solid_tide_bands(place, mjd)
    if terms.pole_tide:
        shift = shift + pole_tide(lon, lat, e["xp"], e["yp"], mjd)
    if terms.ocean_loading:
        gmst = np.degrees(np.arctan2(rot[:, 0, 1], rot[:, 0, 0])) % 360
        shift = shift + ocean_loading(station.loading_amplitude, station.loading_phase, lon, lat, mjd, gmst)
    b = np.einsum("nji,nj->ni", rot, place + shift)
    w = np.cross(np.array([0.0, 0.0, OMEGA_EARTH]), b)
    k = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], -1)
    kb, kv, kw = dot(k, b), dot(k, v), dot(k, w)
    grav = np.zeros(ra.shape)
    if terms.gravitation:
        planets = [(sun + planet_position(n, tt), p[0]) for n, p in PLANETS.items()]
        for body, gm in ((sun, GM_SUN), (moon, GM_MOON), *planets):
            r1, r2 = -body, b - body
            grav += 2 * gm / C_LIGHT**3 * np.log((np.linalg.norm(r1, axis=-1) + dot(k, r1)) / (np.linalg.norm(r2, axis=-1) + dot(k, r2)))
        grav += 2 * GM_EARTH / C_LIGHT**3 * np.log(2 * EARTH_RADIUS / (np.linalg.norm(b, axis=-1) + kb))
    potential = GM_SUN / np.linalg.norm(sun, axis=-1)
    num = grav - kb / C_LIGHT * (1 - 2 * potential / C_LIGHT**2 - dot(v, v) / (2 * C_LIGHT**2) - dot(v, w) / C_LIGHT**2) - dot(v, b) / C_LIGHT**2 * (1 + kv / (2 * C_LIGHT))
    den = 1 + (kv + kw) / C_LIGHT
    tau = num / den
    up, east, north = _local(lon, lat)
    ki = np.einsum("nij,nj->ni", rot, k)
    el, az = np.arcsin(np.clip(dot(ki, up), -1, 1)), np.arctan2(dot(ki, east), dot(ki, north))
    slope = (-b / C_LIGHT - (tau / den)[:, None] * (v + w) / C_LIGHT) / den[:, None]
    by_ra = np.stack([-np.sin(ra), np.cos(ra), np.zeros_like(ra)], -1)
    by_dec = np.stack([-np.sin(dec) * np.cos(ra), -np.sin(dec) * np.sin(ra), np.cos(dec)], -1)
    axis = -station.axis_offset * np.cos(el) / C_LIGHT if terms.axis_offset else 0.0
    return {"tau": tau + axis, "tau_without_axis": tau, "el": el, "az": az, "dtau_dra": dot(slope, by_ra), "dtau_ddec": dot(slope, by_dec)}


# --- troposphere ----------------------------------------------------------------------------------------------------


def _fraction(s: np.ndarray, a, b, c) -> np.ndarray:
    return (1 + a / (1 + b / (1 + c))) / (s + a / (s + b / (s + c)))


def _at(table: np.ndarray, lat_deg: np.ndarray) -> list[np.ndarray]:
    return [np.interp(np.abs(lat_deg), NIELL_LAT, row) for row in table]


def hydrostatic_mapping(el: np.ndarray, lat: np.ndarray, height: np.ndarray, doy: float) -> np.ndarray:
    """Niell's hydrostatic mapping with its season and height terms."""
    deg = np.degrees(lat)
    year = np.cos(2 * np.pi * (doy + np.where(deg < 0, 182.625, 0.0) - 28) / 365.25)
    s = np.sin(el)
    abc = [m - amp * year for m, amp in zip(_at(NIELL_DRY, deg), _at(NIELL_DRY_AMP, deg))]
    return _fraction(s, *abc) + (1 / s - _fraction(s, *NIELL_HEIGHT)) * height / 1000


def wet_mapping(el: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Niell's wet mapping."""
    return _fraction(np.sin(el), *_at(NIELL_WET, np.degrees(lat)))


def gradient_mapping(el: np.ndarray) -> np.ndarray:
    """Chen and Herring's gradient mapping."""
    return 1 / (np.sin(el) * np.tan(el) + 0.0032)


def zenith_hydrostatic(pressure: np.ndarray, lat: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Zenith path in m from surface pressure in hPa."""
    return 0.0022768 * pressure / (1 - 0.00266 * np.cos(2 * lat) - 0.00028 * height / 1000)


def standard_pressure(height: np.ndarray) -> np.ndarray:
    """Pressure of the standard atmosphere in hPa."""
    return 1013.25 * (1 - 2.25577e-5 * np.asarray(height, float)) ** 5.2559


# --- ionosphere -----------------------------------------------------------------------------------------------------


def pierce_point(xyz: np.ndarray, az: np.ndarray, el: np.ndarray, height: float, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latitude, longitude, geocentric elevation) in degrees where the line of sight meets the shell."""
    lon, lat, _ = geodetic(xyz)
    up, east, north = _local(lon, lat)
    k = (np.cos(el) * np.sin(az))[..., None] * east + (np.cos(el) * np.cos(az))[..., None] * north + np.sin(el)[..., None] * up
    r, rk = np.linalg.norm(xyz, axis=-1), (xyz * k).sum(-1)
    p = xyz + (-rk + np.sqrt(np.maximum(rk**2 - r**2 + (base + height) ** 2, 0)))[..., None] * k
    return np.degrees(np.arcsin(p[..., 2] / np.linalg.norm(p, axis=-1))), np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arcsin(np.clip(rk / r, -1, 1)))


def petrov_mapping(el_deg: np.ndarray, height: float, base: float) -> np.ndarray:
    """Modified single-layer mapping at the geocentric elevation."""
    ratio = base / (base + height + PETROV_DH)
    return PETROV_K / np.sqrt(1 - (ratio * np.cos(np.radians(el_deg) * PETROV_ALPHA)) ** 2)


def single_layer_mapping(el_deg: np.ndarray, height: float, base: float) -> np.ndarray:
    """Single-layer mapping at the geodetic elevation."""
    return 1 / np.sqrt(1 - (base / (base + height) * np.cos(np.radians(el_deg))) ** 2)


def tec_delay(tecu: np.ndarray, nu_eff: float) -> np.ndarray:
    """Group delay in s."""
    return K_ION / C_LIGHT * np.asarray(tecu) * TECU / nu_eff**2


@dataclass(frozen=True)
class TecMaps:
    """Vertical TEC on (mjd, lat ascending, lon ascending), with its shell."""

    mjd: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    tec: np.ndarray
    rms: np.ndarray
    base: float = 6371e3
    height: float = 450e3

    def _plane(self, cube: np.ndarray, k: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        lat = np.clip(lat, self.lat[0], self.lat[-1])
        lon = np.clip(self.lon[0] + (lon - self.lon[0]) % 360, self.lon[0], self.lon[-1])
        i = np.clip(np.searchsorted(self.lat, lat) - 1, 0, len(self.lat) - 2)
        j = np.clip(np.searchsorted(self.lon, lon) - 1, 0, len(self.lon) - 2)
        u, v = (lat - self.lat[i]) / (self.lat[i + 1] - self.lat[i]), (lon - self.lon[j]) / (self.lon[j + 1] - self.lon[j])
        return (1 - u) * (1 - v) * cube[k, i, j] + u * (1 - v) * cube[k, i + 1, j] + (1 - u) * v * cube[k, i, j + 1] + u * v * cube[k, i + 1, j + 1]

    def _bracket(self, mjd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.mjd) < 2:
            raise ValueError("at least two maps are needed to interpolate")
        k = np.clip(np.searchsorted(self.mjd, mjd) - 1, 0, len(self.mjd) - 2)
        return k, np.clip((mjd - self.mjd[k]) / (self.mjd[k + 1] - self.mjd[k]), 0, 1)

    def vertical(self, mjd: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """TECU with maps turned along with the Sun."""
        k, w = self._bracket(mjd)
        a = self._plane(self.tec, k, lat, lon + 360 * (mjd - self.mjd[k]))
        return (1 - w) * a + w * self._plane(self.tec, k + 1, lat, lon + 360 * (mjd - self.mjd[k + 1]))

    def uncertainty(self, mjd: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """TECU of the product's own error maps, without turning."""
        k, w = self._bracket(mjd)
        return (1 - w) * self._plane(self.rms, k, lat, lon) + w * self._plane(self.rms, k + 1, lat, lon)

    def slant_delay(self, xyz: np.ndarray, mjd: np.ndarray, az: np.ndarray, el: np.ndarray, nu_eff: float) -> np.ndarray:
        """Delay in s towards a direction."""
        lat, lon, el_gc = pierce_point(xyz, az, el, self.height, self.base)
        return tec_delay(self.vertical(mjd, lat, lon) * petrov_mapping(el_gc, self.height, self.base), nu_eff)


def baseline_correction(d1: dict[str, np.ndarray], d2: dict[str, np.ndarray], primary: str, inflation: float) -> tuple[np.ndarray, np.ndarray]:
    """(correction, sigma): difference of the primary product; spread of all products' differences, inflated."""
    if d1.keys() != d2.keys() or primary not in d1 or len(d1) < 2:
        raise ValueError("two or more equal products, the primary among them")
    diffs = np.stack([d2[k] - d1[k] for k in d1])
    return d2[primary] - d1[primary], inflation * diffs.std(0, ddof=1)


# --- structure ------------------------------------------------------------------------------------------------------


def structure_delay(flux: np.ndarray, x: np.ndarray, y: np.ndarray, dtau_dra: float, dtau_ddec: float, nu: np.ndarray, w: np.ndarray, wrap_threshold: float) -> float:
    """Delay in s of a component model (Jy, mas) over the channels that have weight.

    The phase is unwrapped along ascending channels; a step of wrap_threshold or more gives NaN; no component gives 0.
    """
    if not len(flux):
        return 0.0
    keep = w > 0
    nu, w = nu[keep], w[keep]
    scale = -nu * MAS
    z = (flux * np.exp(2j * np.pi * np.outer(scale, dtau_dra * x + dtau_ddec * y))).sum(1)
    phase = np.angle(z)
    step = np.diff(phase)
    step -= 2 * np.pi * np.rint(step / (2 * np.pi))
    if len(step) and np.abs(step).max() >= wrap_threshold:
        return float("nan")
    phase = np.append(phase[:1], phase[:1] + np.cumsum(step))
    d = nu - np.average(nu, weights=w) if len(nu) else nu
    den = (w * d * d).sum()
    return float(-(w * d * phase).sum() / den / (2 * np.pi)) if den > 0 else 0.0
