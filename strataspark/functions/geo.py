"""Coordinate systems as column expressions.

Transverse Mercator follows the Krueger series in the third flattening, to
fourth order (Karney 2011, "Transverse Mercator with an accuracy of a few
nanometers").  Everything is built-in trigonometry, so it stays in generated
code.  Other families and datum shifts are in
:mod:`strataspark.functions.projections`.  WGS84 and ETRS89 are treated as one
datum.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.projections import (
    GRS80,
    INTERNATIONAL,
    KKJ,
    PROJECTIONS,
    WGS84,
    Helmert,
    as_expression,
    on_frame,
    on_numbers,
)

EXPORT_EPSG = 3067
GEOGRAPHIC_EPSG = 4326
# Longitude and latitude in degrees; WGS84 and ETRS89.
GEOGRAPHIC = (GEOGRAPHIC_EPSG, 4258)
WEB_MERCATOR_EPSG = 3857


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of one transverse Mercator system."""

    central_meridian: float
    false_northing: float = 0.0
    false_easting: float = 500000.0
    scale: float = 0.9996
    ellipsoid: tuple[float, float] = GRS80

    @property
    def flattening(self) -> float:
        return 1.0 / self.ellipsoid[1]

    @property
    def third_flattening(self) -> float:
        return self.flattening / (2.0 - self.flattening)

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2.0 - self.flattening))

    @property
    def scaled_radius(self) -> float:
        n = self.third_flattening
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    # Series coefficients in the third flattening.
    @property
    def alpha(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    @property
    def beta(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )

    @property
    def delta(self) -> tuple[float, ...]:
        n = self.third_flattening
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )


def transverse_mercator(epsg: int) -> TransverseMercator | None:
    """Parameters of a supported transverse Mercator code, else None."""
    if epsg == EXPORT_EPSG:
        return TransverseMercator(27.0)
    if epsg == 3006:
        return TransverseMercator(15.0)
    if 3873 <= epsg <= 3885:
        # Zones of one degree, each with its number before the easting.
        zone = epsg - 3854
        return TransverseMercator(zone, false_easting=zone * 1e6 + 500000.0, scale=1.0)
    if epsg in KKJ_ZONES:
        zone = KKJ_ZONES.index(epsg)
        return TransverseMercator(
            18.0 + 3.0 * zone, 0.0, zone * 1e6 + 500000.0, 1.0, INTERNATIONAL
        )
    family, zone = divmod(epsg, 100)
    meridian = 6.0 * zone - 183.0
    if family == 258 and 28 <= zone <= 38:
        return TransverseMercator(meridian)
    if family == 326 and 1 <= zone <= 60:
        return TransverseMercator(meridian, ellipsoid=WGS84)
    if family == 327 and 1 <= zone <= 60:
        return TransverseMercator(meridian, 10000000.0, ellipsoid=WGS84)
    return None


# Codes of the zones 0 to 5 of the Finnish national system of 1966.
KKJ_ZONES = (3386, 2391, 2392, 2393, 2394, 3387)


def datum_shift(epsg: int) -> Helmert | None:
    """How a code's datum lies to WGS84; None where they are one."""
    return KKJ if epsg in KKJ_ZONES else None


def check_epsg(epsg: int) -> None:
    """Raise for a code no projection is known for."""
    known = (
        epsg in (*GEOGRAPHIC, WEB_MERCATOR_EPSG)
        or epsg in PROJECTIONS
        or transverse_mercator(epsg) is not None
    )
    if not known:
        raise ValueError(
            f"EPSG:{epsg} is not supported; known are {', '.join(map(str, GEOGRAPHIC))}, "
            f"{WEB_MERCATOR_EPSG}, {EXPORT_EPSG}, 3006, UTM zones 258xx, 326xx and 327xx, 3873 to 3885, "
            f"{', '.join(map(str, KKJ_ZONES))}, {', '.join(map(str, sorted(PROJECTIONS)))}"
        )


# Metres beyond which no projected point lies.
_FAR = 1e9


def _staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Add columns stage by stage.

    Each stage's values are used several times by the next, so Catalyst keeps
    the stages as separate projections instead of multiplying the terms out.
    """
    for stage in stages:
        df = df.withColumns(stage)
    return df


def with_projected(
    df: DataFrame, epsg: int, lon: str = "LON", lat: str = "LAT", x: str = "x", y: str = "y"
) -> DataFrame:
    """Add ``x, y`` in ``epsg`` from longitude and latitude (EPSG:4326).

    A latitude beyond the poles has no projection and gives NULL.
    """
    check_epsg(epsg)
    lon_c, lat_c = F.col(lon), F.col(lat)
    if epsg in GEOGRAPHIC:
        return df.withColumns({x: lon_c, y: lat_c})
    safe_lat = F.when(F.abs(lat_c) <= 90.0, lat_c)
    if epsg in PROJECTIONS:
        start = {"lon": lon_c, "lat": safe_lat}
        placed = on_frame(df, PROJECTIONS[epsg].forward(), start, {"x": x, "y": y})
        # A point that the family sends to infinity has no place.
        return placed.withColumns({c: F.when(F.abs(c) < _FAR, F.col(c)) for c in (x, y)})
    shift = datum_shift(epsg)
    if shift is not None:
        start = {"lon": lon_c, "lat": safe_lat}
        df = on_frame(df, shift.from_wgs84(), start, {"lon": "_shifted_lon", "lat": "_shifted_lat"})
        lon_c, safe_lat = F.col("_shifted_lon"), F.col("_shifted_lat")
    if epsg == WEB_MERCATOR_EPSG:
        radius = F.lit(WGS84[0])
        north = radius * F.atanh(F.sin(F.radians(safe_lat)))
        return df.withColumns({x: radius * F.radians(lon_c), y: north})
    tm = transverse_mercator(epsg)
    e = tm.eccentricity
    sin_lat, t, d_lon, xi, eta = (F.col(f"_p_{n}") for n in ("sin", "t", "lon", "xi", "eta"))
    east, north = eta, xi
    for j, a in enumerate(tm.alpha, start=1):
        east = east + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        north = north + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    return _staged(
        df,
        {
            "_p_sin": F.sin(F.radians(safe_lat)),
            "_p_lon": F.radians(lon_c - F.lit(tm.central_meridian)),
        },
        {"_p_t": F.sinh(F.atanh(sin_lat) - F.lit(e) * F.atanh(F.lit(e) * sin_lat))},
        {
            "_p_xi": F.atan2(t, F.cos(d_lon)),
            "_p_eta": F.atanh(F.sin(d_lon) / F.sqrt(F.lit(1.0) + t * t)),
        },
        {
            x: F.lit(tm.false_easting) + F.lit(tm.scaled_radius) * east,
            y: F.lit(tm.false_northing) + F.lit(tm.scaled_radius) * north,
        },
    ).drop("_p_sin", "_p_lon", "_p_t", "_p_xi", "_p_eta", "_shifted_lon", "_shifted_lat")


def keep_in_box(
    df: DataFrame, bounds: tuple[float, float, float, float], x: str = "x", y: str = "y"
) -> DataFrame:
    """Rows whose computed point lies in the box, edges included.

    The point passes through a one-element generator.  A filter is pushed below
    projections by writing their terms into it, which here would repeat the
    whole series for each comparison; it is not pushed below a generator.
    """
    others = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.col(x).alias(x), F.col(y).alias(y))
    fixed = df.select(*others, F.inline(F.array(point)))
    return fixed.where(in_box(F.col(x), F.col(y), bounds))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once where a term is needed several times in a lambda."""
    return F.transform(F.array(value), body)[0]


def unproject(x: Column, y: Column, epsg: int) -> Column:
    """``(x, y)`` in ``epsg`` to ``[lon, lat]`` (EPSG:4326); fit for lambdas."""
    check_epsg(epsg)
    if epsg in GEOGRAPHIC:
        return F.array(x, y)
    if epsg in PROJECTIONS:
        stages = PROJECTIONS[epsg].inverse()
        return as_expression(stages, ["lon", "lat"], x=x.cast("double"), y=y.cast("double"))
    shift = datum_shift(epsg)
    if epsg == WEB_MERCATOR_EPSG:
        radius = F.lit(WGS84[0])
        return F.array(F.degrees(x / radius), F.degrees(F.atan(F.sinh(y / radius))))
    tm = transverse_mercator(epsg)

    def rectified(p: Column) -> Column:
        xi, eta = p[0], p[1]
        for j, b in enumerate(tm.beta, start=1):
            xi = xi - F.lit(b) * F.sin(p[0] * (2.0 * j)) * F.cosh(p[1] * (2.0 * j))
            eta = eta - F.lit(b) * F.cos(p[0] * (2.0 * j)) * F.sinh(p[1] * (2.0 * j))
        return let(F.array(xi, eta), conformal)

    def conformal(p: Column) -> Column:
        lon = F.lit(tm.central_meridian) + F.degrees(F.atan2(F.sinh(p[1]), F.cos(p[0])))
        return F.array(lon, let(F.asin(F.sin(p[0]) / F.cosh(p[1])), latitude))

    def latitude(chi: Column) -> Column:
        lat = chi
        for j, d in enumerate(tm.delta, start=1):
            lat = lat + F.lit(d) * F.sin(chi * (2.0 * j))
        return F.degrees(lat)

    scaled = F.array(
        (y - F.lit(tm.false_northing)) / F.lit(tm.scaled_radius),
        (x - F.lit(tm.false_easting)) / F.lit(tm.scaled_radius),
    )
    if shift is None:
        return let(scaled, rectified)
    return let(
        let(scaled, rectified),
        lambda p: as_expression(shift.to_wgs84(), ["lon", "lat"], lon=p[0], lat=p[1]),
    )


def in_box(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Point in the box ``(xmin, ymin, xmax, ymax)``, edges included.

    The corners may come in any order.
    """
    x0, y0, x1, y1 = bounds
    inside = x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))
    return F.coalesce(inside, F.lit(False))


def _unproject_point(x: float, y: float, epsg: int) -> tuple[float, float] | None:
    """The inverse projection of one point of a box border, on the driver."""
    if epsg in GEOGRAPHIC:
        return x, y
    if epsg in PROJECTIONS:
        try:
            found = on_numbers(PROJECTIONS[epsg].inverse(), x=x, y=y)
        except (ValueError, OverflowError):
            return None
        return found.lon, found.lat
    if epsg == WEB_MERCATOR_EPSG:
        radius = WGS84[0]
        return math.degrees(x / radius), math.degrees(math.atan(math.sinh(y / radius)))
    tm = transverse_mercator(epsg)
    xi0 = (y - tm.false_northing) / tm.scaled_radius
    eta0 = (x - tm.false_easting) / tm.scaled_radius
    # Beyond these limits the series is no longer one-to-one.
    if abs(eta0) > 0.6 or abs(xi0) > 1.5:
        return None
    xi, eta = xi0, eta0
    for j, b in enumerate(tm.beta, start=1):
        xi -= b * math.sin(2 * j * xi0) * math.cosh(2 * j * eta0)
        eta -= b * math.cos(2 * j * xi0) * math.sinh(2 * j * eta0)
    chi = math.asin(math.sin(xi) / math.cosh(eta))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(tm.delta, start=1))
    lon = math.radians(tm.central_meridian) + math.atan2(math.sinh(eta), math.cos(xi))
    lon, lat = math.degrees(lon), math.degrees(lat)
    shift = datum_shift(epsg)
    if shift is None:
        return lon, lat
    found = on_numbers(shift.to_wgs84(), lon=lon, lat=lat)
    return found.lon, found.lat


def _reaches_pole(x0: float, y0: float, x1: float, y1: float, epsg: int) -> bool:
    """Whether a pole lies in the box, or so near that its border cannot tell."""
    if epsg not in PROJECTIONS:
        return False
    pad_x, pad_y = 1.0 + 0.05 * (x1 - x0), 1.0 + 0.05 * (y1 - y0)
    for lat in (-90.0, 90.0):
        pole = on_numbers(PROJECTIONS[epsg].forward(), lon=0.0, lat=lat)
        if x0 - pad_x <= pole.x <= x1 + pad_x and y0 - pad_y <= pole.y <= y1 + pad_y:
            return True
    return False


def geographic_envelope(
    bounds: tuple[float, float, float, float], epsg: int, steps: int = 64
) -> tuple[float, float, float, float] | None:
    """Longitude/latitude box that holds every point of a projected box.

    The border is sampled and padded by more than it can bulge between two
    samples.  None when the box reaches where no safe envelope is known; the
    exact test then stands alone.
    """
    check_epsg(epsg)
    x0, x1 = sorted((bounds[0], bounds[2]))
    y0, y1 = sorted((bounds[1], bounds[3]))
    if not all(math.isfinite(v) for v in (x0, y0, x1, y1)):
        return None
    grid = [i / steps for i in range(steps + 1)]
    border = [(x0 + g * (x1 - x0), y) for g in grid for y in (y0, y1)]
    border += [(x, y0 + g * (y1 - y0)) for g in grid for x in (x0, x1)]
    points = [_unproject_point(x, y, epsg) for x, y in border]
    if any(p is None for p in points):
        return None
    if _reaches_pole(x0, y0, x1, y1, epsg):
        return None
    lons, lats = zip(*points, strict=True)
    if epsg in PROJECTIONS and max(lons) - min(lons) > 180:
        # The border crosses the antimeridian, or nearly surrounds a pole.
        return None
    pad_lon = 1e-6 + 0.02 * (max(lons) - min(lons))
    pad_lat = 1e-6 + 0.02 * (max(lats) - min(lats))
    if min(lons) - pad_lon < -180 or max(lons) + pad_lon > 180:
        # Beyond the antimeridian the same places have other longitudes.
        return None
    return min(lons) - pad_lon, min(lats) - pad_lat, max(lons) + pad_lon, max(lats) + pad_lat


# Steps that put a zero bit before each of a number's lowest 32 bits.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)
_CURVE_BITS = 26  # per direction: cells of about half a metre


def curve_place(latitude: str, longitude: str) -> Column:
    """Place on a Z-shaped curve through cells of latitude and longitude; near cells are mostly near on it.

    NULL where either is; degrees beyond the globe count as its edge.
    """

    def cells(degrees: str, half: float) -> Column:
        count = 1 << _CURVE_BITS
        cell = (F.col(degrees) + half) * (count / (2 * half))
        bits = F.floor(F.least(F.greatest(cell, F.lit(0.0)), F.lit(count - 1.0))).cast("long")
        for shift, mask in _SPREAD:
            bits = let(bits, lambda b: b.bitwiseOR(F.shiftleft(b, shift)).bitwiseAND(F.lit(mask)))
        return F.when(F.col(degrees).isNotNull(), bits)

    return F.shiftleft(cells(latitude, 90.0), 1).bitwiseOR(cells(longitude, 180.0))


def point_wkb(x: Column, y: Column) -> Column:
    """Little-endian WKB of a 2-D point."""
    return F.concat(F.unhex(F.lit("0101000000")), _double_le(x), _double_le(y))


def _double_le(value: Column) -> Column:
    """IEEE 754 bytes of a double, little-endian, by arithmetic.

    Spark has no cast from double to its bits, so sign, exponent and mantissa
    are taken apart.  Exact for zero and normal numbers; coordinates are both.
    Each part is bound once, or the plan would repeat it for every byte.
    """
    magnitude = F.abs(value)

    def exponent(raw: Column) -> Column:
        # log2 may round up across a power of two, so correct by comparison.
        return (
            F.when(F.pow(F.lit(2.0), raw) > magnitude, raw - 1)
            .when(F.pow(F.lit(2.0), raw + 1) <= magnitude, raw + 1)
            .otherwise(raw)
        )

    def digits(power: Column) -> Column:
        mantissa = ((magnitude / F.pow(F.lit(2.0), power) - 1.0) * float(2**52)).cast("long")
        bits = F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(mantissa)
        bits = F.when(magnitude == 0.0, F.lit(0).cast("long")).otherwise(bits)
        signed = F.when(value < 0.0, bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)
        return F.lpad(F.hex(signed), 16, "0")

    def turned(big_endian: Column) -> Column:
        pairs = [F.substring(big_endian, 2 * i + 1, 2) for i in reversed(range(8))]
        return F.unhex(F.concat(*pairs))

    return let(let(let(F.floor(F.log2(magnitude)), exponent), digits), turned)
