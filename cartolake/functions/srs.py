"""Spatial reference systems: parsing, equality, units, and projection in closed form or short series.

Long/lat, Mercator, transverse Mercator and UTM, Lambert's conformal conic, Albers' equal-area conic, Lambert's azimuthal equal-area, the
stereographic, equidistant and equal-area cylindrical projections, on the sphere or an ellipsoid, are arithmetic on columns. Other projections,
and shifts between datums, are refused by name. Codes are the common ones; UTM zones follow from their number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Definitions of the codes that are known without tables.
CODES = {
    4326: "+proj=longlat +datum=WGS84 +no_defs",
    4258: "+proj=longlat +ellps=GRS80 +no_defs",
    3857: "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +no_defs",
    900913: "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +no_defs",
    3395: "+proj=merc +lon_0=0 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
    54004: "+proj=merc +lon_0=0 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
    4269: "+proj=longlat +datum=NAD83 +no_defs",
    2154: "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80 +units=m +no_defs",
    3034: "+proj=lcc +lat_1=35 +lat_2=65 +lat_0=52 +lon_0=10 +x_0=4000000 +y_0=2800000 +ellps=GRS80 +units=m +no_defs",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80 +units=m +no_defs",
    5070: "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83 +units=m +no_defs",
    3577: "+proj=aea +lat_1=-18 +lat_2=-36 +lat_0=0 +lon_0=132 +x_0=0 +y_0=0 +ellps=GRS80 +units=m +no_defs",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
    32661: "+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84 +units=m +no_defs",
    4087: "+proj=eqc +lat_ts=0 +lat_0=0 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
    6933: "+proj=cea +lat_ts=30 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs",
}
#: Series of codes of UTM zones, as first code, zones, and what the definition adds.
UTM = [(32601, range(1, 61), "+datum=WGS84"), (32701, range(1, 61), "+south +datum=WGS84"), (25828, range(28, 38), "+ellps=GRS80"), (26901, range(1, 24), "+datum=NAD83")]
WGS84 = CODES[4326]
# Semi-major axes and inverse flattenings.
_ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "sphere": (6370997.0, 0.0), "clrk66": (6378206.4, 294.978698214), "bessel": (6377397.155, 299.1528128), "intl": (6378388.0, 297.0), "krass": (6378245.0, 298.3)}
LIMIT = 1000.0  # an extent within it is taken for degrees


def definition(code: int) -> str:
    """The Proj string of a code."""
    if code in CODES:
        return CODES[code]
    for first, zones, rest in UTM:
        if 0 <= code - first < len(zones):
            return f"+proj=utm +zone={zones[code - first]} {rest} +units=m +no_defs"
    raise ValueError(f"reference system {code} isn't known here")


def params(text: str) -> dict[str, str]:
    """Parameters of a definition: a Proj string, an EPSG or ESRI code, or WKT as .prj files have it."""
    text = text.strip()
    if m := re.fullmatch(r"(?:(?:EPSG|ESRI)\s*:{1,2}\s*)?([0-9]+)", text, re.I):
        text = definition(int(m[1]))
    if not text.startswith("+"):
        text = wkt_to_proj(text)
    pairs = (p.partition("=") for p in re.findall(r"\+(\S+)", text))
    return {k: v for k, _, v in pairs}


def wkt_to_proj(wkt: str) -> str:
    """The Proj string of a GEOGCS or PROJCS with a projection that is known here."""
    number = r"([-+0-9.eE]+)"
    sphere = re.search(rf'SPHEROID\s*\[\s*"[^"]*"\s*,\s*{number}\s*,\s*{number}', wkt, re.I)
    if not re.match(r"\s*(?:GEOGCS|PROJCS)\s*\[", wkt, re.I) or not sphere:
        raise ValueError("not a definition of a reference system")
    a, inverse = float(sphere[1]), float(sphere[2])
    body = f"+a={a:g} +b={a * (1 - 1 / inverse) if inverse else a:.10f}".replace("6.37814e+06", "6378137")
    if a == 6378137.0 and abs(inverse - 298.257223563) < 1e-6:
        body = "+datum=WGS84"
    if re.match(r"\s*GEOGCS", wkt, re.I):
        return f"+proj=longlat {body} +no_defs"
    kind = (re.search(r'PROJECTION\s*\[\s*"([^"]*)"', wkt, re.I) or ["", ""])[1].lower()
    found = {k.lower(): v for k, v in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*{number}', wkt, re.I)}
    proj = next((p for names, p in _WKT_NAMES if all(n in kind for n in names)), None)
    if not proj:
        raise ValueError(f"projection {kind or 'unnamed'} has no closed form here")
    if "auxiliary" in kind or "pseudo" in wkt.lower():
        body = f"+a={a:.0f} +b={a:.0f}"
    asked = [f"+{name}={float(found[key]):.15g}" for keys, name in _WKT_PARAMETERS for key in keys[:1] + tuple(k for k in keys[1:] if keys[0] not in found) if key in found]
    if proj == "lcc" and "1sp" in kind and "lat_1" not in " ".join(asked):
        asked.append(f"+lat_1={float(found.get('latitude_of_origin', 0)):.15g}")
    return f"+proj={proj} {body} {' '.join(asked)} +units=m +no_defs"


#: Words in a projection's name, the first that all occur; and names of parameters, with the Proj parameter they stand for.
_WKT_NAMES = [(("transverse", "mercator"), "tmerc"), (("gauss",), "tmerc"), (("mercator",), "merc"), (("lambert", "conformal"), "lcc"), (("albers",), "aea"), (("lambert", "azimuthal"), "laea"), (("stereographic",), "stere"), (("cylindrical", "equal"), "cea"), (("equidistant", "cylindrical"), "eqc"), (("plate",), "eqc")]
_WKT_PARAMETERS = [
    (("central_meridian", "longitude_of_center", "longitude_of_origin"), "lon_0"), (("latitude_of_origin", "latitude_of_center"), "lat_0"), (("standard_parallel_1",), "lat_1"), (("standard_parallel_2",), "lat_2"),
    (("false_easting",), "x_0"), (("false_northing",), "y_0"), (("scale_factor",), "k"),
]


def to_wkt(text: str) -> str:
    """WKT as .prj files have it, of a definition; what wkt_to_proj() reads again."""
    p = params(text)
    a, e = _shape(p)
    inverse = 1 / (1 - math.sqrt(1 - e * e)) if e else 0.0
    sphere = f'SPHEROID["{p.get("ellps") or p.get("datum") or "custom"}",{a:.15g},{inverse:.15g}]'
    geographic = f'GEOGCS["GCS",DATUM["D",{sphere}],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]]'
    if is_geographic(text):
        return geographic
    p = _utm(p)
    name = {"tmerc": "Transverse_Mercator", "merc": "Mercator", "lcc": "Lambert_Conformal_Conic", "aea": "Albers", "laea": "Lambert_Azimuthal_Equal_Area", "stere": "Stereographic", "cea": "Cylindrical_Equal_Area", "eqc": "Equidistant_Cylindrical"}[p["proj"]]
    if p["proj"] == "merc" and not e:
        name = "Mercator_Auxiliary_Sphere"
    given = "".join(f',PARAMETER["{keys[0]}",{float(p[n]):.15g}]' for keys, n in _WKT_PARAMETERS if p.get(n))
    return f'PROJCS["PCS",{geographic},PROJECTION["{name}"]{given},UNIT["Meter",1]]'


def to_proj(text: str) -> str:
    return " ".join(f"+{k}={v}" if v else f"+{k}" for k, v in params(text).items())


def same(a: str, b: str) -> bool:
    """Whether definitions have the same parameters, in any order, +no_defs apart."""
    drop = lambda p: sorted((k, v) for k, v in p.items() if k != "no_defs")
    return drop(params(a)) == drop(params(b))


def is_geographic(text: str) -> bool:
    return params(text).get("proj") in ("longlat", "latlong", "lonlat", "latlon")


def units(text: str) -> str:
    return "decimal_degrees" if is_geographic(text) else "meters"


def guess(extent: tuple[float, float, float, float]) -> str | None:
    """WGS84 if all bounds are within LIMIT, else unknown."""
    return WGS84 if all(abs(v) <= LIMIT for v in extent) else None


def _shape(p: dict[str, str]) -> tuple[float, float]:
    """Semi-major axis and eccentricity."""
    if "R" in p:
        return float(p["R"]), 0.0
    if "a" in p:
        a = float(p["a"])
        b = float(p["b"]) if "b" in p else a * (1 - 1 / float(p["rf"])) if "rf" in p else a
        return a, math.sqrt(max(0.0, 1 - (b / a) ** 2))
    a, inverse = _ELLIPSOIDS[p.get("ellps") or {"WGS84": "WGS84", "NAD83": "GRS80"}.get(p.get("datum", "WGS84"), "WGS84")]
    f = 1 / inverse if inverse else 0.0
    return a, math.sqrt(f * (2 - f))


def cut_meridian(text: str) -> float | None:
    """The meridian opposite the central one, where a projected map is cut; None without a central one."""
    p = _utm(params(text))
    if not p.get("lon_0"):
        return None
    lon0 = float(p["lon_0"])
    return lon0 - 180 if lon0 > 0 else lon0 + 180


def parallel_range(text: str) -> tuple[float, float]:
    """The parallels between which a projection shows the earth. Fixed values by projection."""
    return {"aea": (-90.0, 89.9), "lcc": (-59.9, 89.9)}.get(params(text).get("proj", ""), (-89.9, 89.9))


class _Math:
    """The functions that projections need, over columns or numbers."""

    def __init__(self, column: bool) -> None:
        self.column = column
        for name in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "asinh", "exp", "log", "sqrt"):
            setattr(self, name, getattr(F if column else math, name))

    def clamp(self, x):  # noqa: ANN001, ANN201
        """x within -1 and 1, for arcs."""
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) if self.column else max(-1.0, min(1.0, x))

    def below(self, x, least: float):  # noqa: ANN001, ANN201
        return F.greatest(x, F.lit(least)) if self.column else max(x, least)


RAD = math.pi / 180


def _utm(p: dict[str, str]) -> dict[str, str]:
    """A UTM zone as the transverse Mercator that it is."""
    if p.get("proj") != "utm":
        return p
    zone = int(p["zone"])
    rest = {k: v for k, v in p.items() if k not in ("proj", "zone", "south")}
    return {"proj": "tmerc", "lat_0": "0", "lon_0": str(6 * zone - 183), "k": "0.9996", "x_0": "500000", "y_0": "10000000" if "south" in p else "0"} | rest


def _t(m: _Math, phi, e: float):  # noqa: ANN001, ANN202
    """exp of minus the isometric latitude."""
    s = m.sin(phi) * e
    return m.tan((phi * -0.5) + math.pi / 4) * m.exp(m.log((1 + s) / (1 - s)) * (e / 2))


def _phi_of_t(m: _Math, t, e: float):  # noqa: ANN001, ANN202
    phi = m.atan(t) * -2 + math.pi / 2
    for _ in range(7 if e else 0):
        s = m.sin(phi) * e
        phi = m.atan(t * m.exp(m.log((1 - s) / (1 + s)) * (e / 2))) * -2 + math.pi / 2
    return phi


def _q(m: _Math, phi, e: float):  # noqa: ANN001, ANN202
    """Twice the authalic sine, times the area's unit."""
    s = m.sin(phi)
    if not e:
        return s * 2
    return (s / (1 - s * s * (e * e)) - m.log((1 - s * e) / (1 + s * e)) * (1 / (2 * e))) * (1 - e * e)


def _phi_of_q(m: _Math, q, e: float):  # noqa: ANN001, ANN202
    """By the series in the authalic latitude."""
    qp = _q(_Math(False), math.pi / 2, e)
    beta = m.asin(m.clamp(q / qp))
    e2, e4, e6 = e**2, e**4, e**6
    phi = beta + m.sin(beta * 2) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + m.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780) + m.sin(beta * 6) * (761 * e6 / 45360)
    for _ in range(2 if e else 0):  # Newton's steps; at the poles, where the slope ends, they stay
        s, c = m.sin(phi), m.below(m.cos(phi), 1e-9)
        w = 1 - s * s * e2
        phi = phi + w * w / (c * 2) * (q / (1 - e2) - s / w + m.log((1 - s * e) / (1 + s * e)) * (1 / (2 * e))) if e else phi
    return phi


def _m(phi: float, e: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _tmerc(p: dict[str, float], a: float, e: float, m: _Math) -> tuple[Callable, Callable]:
    """By Krueger's series in the third flattening, to its fourth power."""
    n = (1 - math.sqrt(1 - e * e)) / (1 + math.sqrt(1 - e * e))
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    scaled = radius * p["k"]

    def raw(mm: _Math, lam, phi):  # noqa: ANN001, ANN202
        tau = mm.sinh(mm.log(_t(mm, phi, e)) * -1)
        xi, eta = mm.atan2(tau, mm.cos(lam)), mm.asinh(mm.sin(lam) / mm.sqrt(tau * tau + mm.cos(lam) * mm.cos(lam)))
        north, east = xi, eta
        for j, c in enumerate(alpha, 1):
            north = north + mm.sin(xi * (2 * j)) * mm.cosh(eta * (2 * j)) * c
            east = east + mm.cos(xi * (2 * j)) * mm.sinh(eta * (2 * j)) * c
        return east * scaled, north * scaled

    origin = raw(_Math(False), 0.0, p["lat_0"])[1]

    def forward(lam, phi):  # noqa: ANN001, ANN202
        x, y = raw(m, lam, phi)
        return x, y - origin

    def back(x, y):  # noqa: ANN001, ANN202
        xi, eta = (y + origin) * (1 / scaled), x * (1 / scaled)
        north, east = xi, eta
        for j, c in enumerate(beta, 1):
            north = north - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
            east = east - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
        sine = m.clamp(m.sin(north) / m.cosh(east))
        t = m.sqrt((1 - sine) / (1 + sine))
        return m.atan2(m.sinh(east), m.cos(north)), _phi_of_t(m, t, e)

    return forward, back


def _conic(kind: str, p: dict[str, float], a: float, e: float, m: _Math) -> tuple[Callable, Callable]:
    f = _Math(False)
    one, two = p["lat_1"], p["lat_2"]
    m1, m2 = _m(one, e), _m(two, e)
    if kind == "lcc":
        t1, t2 = _t(f, one, e), _t(f, two, e)
        n = math.sin(one) if abs(one - two) < 1e-10 else math.log(m1 / m2) / math.log(t1 / t2)
        big = a * p["k"] * m1 / (n * t1**n)
        rho = lambda mm, phi: mm.exp(mm.log(_t(mm, phi, e)) * n) * big
        phi_of = lambda r: _phi_of_t(m, m.exp(m.log(r * (1 / big)) * (1 / n)), e)
    else:
        q1, q2 = _q(f, one, e), _q(f, two, e)
        n = math.sin(one) if abs(one - two) < 1e-10 else (m1**2 - m2**2) / (q2 - q1)
        c = m1**2 + n * q1
        rho = lambda mm, phi: mm.sqrt(mm.below(_q(mm, phi, e) * -n + c, 0.0)) * (a / n)
        phi_of = lambda r: _phi_of_q(m, (r * r * (-((n / a) ** 2)) + c) * (1 / n), e)
    origin = rho(f, p["lat_0"])

    def forward(lam, phi):  # noqa: ANN001, ANN202
        r = rho(m, phi)
        return r * m.sin(lam * n), r * m.cos(lam * n) * -1 + origin

    sign = 1.0 if n > 0 else -1.0

    def back(x, y):  # noqa: ANN001, ANN202
        up = y * -1 + origin
        r = m.sqrt(x * x + up * up) * sign
        return m.atan2(x * sign, up * sign) * (1 / n), phi_of(r)

    return forward, back


def _azimuthal(kind: str, p: dict[str, float], a: float, e: float, m: _Math) -> tuple[Callable, Callable]:
    """Lambert's equal-area and the stereographic projection. Poles have forms of their own."""
    f, lat0 = _Math(False), p["lat_0"]
    polar = abs(abs(lat0) - math.pi / 2) < 1e-10
    sign = 1.0 if lat0 > 0 else -1.0
    if polar:
        if kind == "laea":
            qp = _q(f, math.pi / 2, e)
            rho = lambda phi: m.sqrt(m.below(_q(m, phi, e) * -1 + qp, 0.0)) * a
            phi_of = lambda r: _phi_of_q(m, r * r * (-1 / a**2) + qp, e)
        else:
            at = abs(p["lat_ts"]) if p["lat_ts"] else math.pi / 2
            if abs(at - math.pi / 2) < 1e-10:
                big = 2 * a * p["k"] / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
            else:
                big = a * p["k"] * _m(at, e) / _t(f, at, e)
            rho = lambda phi: _t(m, phi, e) * big
            phi_of = lambda r: _phi_of_t(m, r * (1 / big), e)

        def forward(lam, phi):  # noqa: ANN001, ANN202
            r = rho(phi * sign)
            return r * m.sin(lam), r * m.cos(lam) * -sign

        def back(x, y):  # noqa: ANN001, ANN202
            return m.atan2(x, y * -sign), phi_of(m.sqrt(x * x + y * y)) * sign

        return forward, back
    m1 = _m(lat0, e)
    if kind == "laea":
        qp = _q(f, math.pi / 2, e)
        first, radius = math.asin(max(-1.0, min(1.0, _q(f, lat0, e) / qp))), a * math.sqrt(qp / 2)
        d = a * m1 / (radius * math.cos(first))
        aux = lambda phi: m.asin(m.clamp(_q(m, phi, e) * (1 / qp)))
        scale = lambda inner: m.sqrt(m.below(inner, 1e-12) * 0.5)
        angle = lambda r: m.asin(m.clamp(r * (1 / (2 * radius)))) * 2
        phi_of = lambda sine: _phi_of_q(m, sine * qp, e)
    else:
        first, d = math.pi / 2 - 2 * math.atan(_t(f, lat0, e)), 1.0
        radius = 2 * a * p["k"] * m1 / math.cos(first)
        aux = lambda phi: m.atan(_t(m, phi, e)) * -2 + math.pi / 2
        scale = lambda inner: m.below(inner, 1e-12)
        angle = lambda r: m.atan(r * (1 / radius)) * 2
        phi_of = lambda sine: _phi_of_t(m, m.sqrt(m.below(1 - sine, 0.0) / (1 + sine)), e)
    s1, c1 = math.sin(first), math.cos(first)

    def forward(lam, phi):  # noqa: ANN001, ANN202
        b = aux(phi)
        inner = m.sin(b) * s1 + m.cos(b) * m.cos(lam) * c1
        k = 1 / scale(inner + 1)
        return k * m.cos(b) * m.sin(lam) * (radius * d), k * (m.sin(b) * c1 - m.cos(b) * m.cos(lam) * s1) * (radius / d)

    def back(x, y):  # noqa: ANN001, ANN202
        u, v = x * (1 / d), y * d
        r = m.below(m.sqrt(u * u + v * v), 1e-12)
        c = angle(r)
        sine = m.clamp(m.cos(c) * s1 + v * m.sin(c) * c1 / r)
        return m.atan2(u * m.sin(c), r * m.cos(c) * c1 - v * m.sin(c) * s1), phi_of(sine)

    return forward, back


def _cylindrical(kind: str, p: dict[str, float], a: float, e: float, m: _Math) -> tuple[Callable, Callable]:
    if kind == "merc":
        r = a * (_m(p["lat_ts"], e) if p["lat_ts"] else p["k"])
        return lambda lam, phi: (lam * r, m.log(_t(m, phi, e)) * -r), lambda x, y: (x * (1 / r), _phi_of_t(m, m.exp(y * (-1 / r)), e))
    if kind == "cea":
        k = _m(p["lat_ts"], e)
        return lambda lam, phi: (lam * (a * k), _q(m, phi, e) * (a / (2 * k))), lambda x, y: (x * (1 / (a * k)), _phi_of_q(m, y * (2 * k / a), e))
    k = math.cos(p["lat_ts"])
    return lambda lam, phi: (lam * (a * k), (phi - p["lat_0"]) * a), lambda x, y: (x * (1 / (a * k)), y * (1 / a) + p["lat_0"])


_KINDS = {"tmerc": _tmerc, "lcc": _conic, "aea": _conic, "laea": _azimuthal, "stere": _azimuthal, "merc": _cylindrical, "cea": _cylindrical, "eqc": _cylindrical}


def _projector(text: str, inverse: bool, m: _Math) -> Callable:
    p = _utm(params(text))
    kind = p.get("proj", "longlat")
    if is_geographic(text):
        return lambda x, y: (x, y)
    if kind not in _KINDS:
        raise ValueError(f"projection {kind} has no closed form here")
    a, e = _shape(p)
    number = lambda n, default=0.0: float(p.get(n) or default)
    lon0, x0, y0 = number("lon_0"), number("x_0"), number("y_0")
    angles = {n: number(n) * RAD for n in ("lat_0", "lat_ts")}
    angles["lat_1"] = number("lat_1", number("lat_0")) * RAD
    angles["lat_2"] = number("lat_2") * RAD if "lat_2" in p else angles["lat_1"]
    own = angles | {"k": number("k", number("k_0", 1.0))}
    forward, back = _KINDS[kind](own, a, e, m) if kind == "tmerc" else _KINDS[kind](kind, own, a, e, m)

    def there(lon, lat):  # noqa: ANN001, ANN202
        x, y = forward((lon - lon0) * RAD, lat * RAD)
        return x + x0, y + y0

    def here(x, y):  # noqa: ANN001, ANN202
        lam, phi = back(x - x0, y - y0)
        return lam * (1 / RAD) + lon0, phi * (1 / RAD)

    return here if inverse else there


def transformer(source: str, target: str) -> Callable[[Column, Column], Column]:
    """From x and y columns to a struct of x and y in the target; NULL where the target can't show the point."""
    m = _Math(True)
    back, forward = _projector(source, True, m), _projector(target, False, m)
    limited = not is_geographic(target) and is_geographic(source)

    def move(x: Column, y: Column) -> Column:
        if same(source, target):
            return F.struct(x.alias("x"), y.alias("y"))
        lon, lat = back(x, y)
        nx, ny = forward(lon, lat)
        good = (F.abs(y) < 90) & (F.abs(x) <= 360) if limited else F.lit(True)
        return F.struct(F.when(good, nx).alias("x"), F.when(good, ny).alias("y"))

    return move


def project_point(x: float, y: float, source: str, target: str) -> tuple[float, float] | None:
    if same(source, target):
        return x, y
    m = _Math(False)
    if is_geographic(source) and not is_geographic(target) and abs(y) >= 90:
        return None
    forward, back = _projector(target, False, m), _projector(source, True, m)
    try:
        return forward(*back(x, y))
    except (ValueError, OverflowError):
        return None


def project_box(box: tuple[float, float, float, float], source: str, target: str, precision: int = 20) -> tuple[float, float, float, float]:
    """The box of a box's outline, precision points a side, in another reference system."""
    if same(source, target):
        return box
    x0, y0, x1, y1 = box
    if is_geographic(source) and not is_geographic(target):
        y0, y1 = max(y0, -89.999999), min(y1, 89.999999)
    steps = [i / precision for i in range(precision)]
    outline = [(x0 + (x1 - x0) * t, y0) for t in steps] + [(x1, y0 + (y1 - y0) * t) for t in steps] + [(x1 - (x1 - x0) * t, y1) for t in steps] + [(x0, y1 - (y1 - y0) * t) for t in steps] + [(x0, y0)]
    moved = [p for x, y in outline if (p := project_point(x, y, source, target))]
    if not moved:
        raise ValueError("the box has no part that the reference system shows")
    return min(p[0] for p in moved), min(p[1] for p in moved), max(p[0] for p in moved), max(p[1] for p in moved)
