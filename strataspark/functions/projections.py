"""Families of map projections beside transverse Mercator, and datum shifts.

A projection is written once, as stages of formulas over named values, and runs in three ways: as
columns added stage by stage, as one nested expression fit for lambdas, and on plain numbers in the
driver.  A stage uses the values of those before it, so no term is repeated.

Formulas follow the IOGP guidance note 373-7-2 (conic, azimuthal and stereographic methods, position
vector transformation); conformal methods use the isometric latitude, which is exact at the poles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ellipsoid = tuple[float, float]

# Ellipsoids as (semi-major axis, inverse flattening).
GRS80: Ellipsoid = (6378137.0, 298.257222101)
WGS84: Ellipsoid = (6378137.0, 298.257223563)
INTERNATIONAL: Ellipsoid = (6378388.0, 297.0)

Values = SimpleNamespace
Stage = Callable[[Any, Values], Mapping[str, Any]]


def _atanh(x: float) -> float:
    return math.copysign(math.inf, x) if abs(x) == 1.0 else math.atanh(x)


def _exp(x: float) -> float:
    return math.inf if x > 700 else math.exp(x)


#: The functions that formulas use, on plain numbers.
NUMBERS = SimpleNamespace(
    sin=math.sin, cos=math.cos, asin=math.asin, atan2=math.atan2, atanh=_atanh, exp=_exp,
    pow=math.pow, sqrt=math.sqrt, radians=math.radians, degrees=math.degrees,
    wrapped=lambda lon: (lon + 180.0) % 360.0 - 180.0,
    capped=lambda x: max(-1.0, min(1.0, x)),
    over=lambda x, y: x / y if y else math.inf,
)
#: The same on columns.
COLUMNS = SimpleNamespace(
    sin=F.sin, cos=F.cos, asin=F.asin, atan2=F.atan2, atanh=F.atanh, exp=F.exp,
    pow=F.pow, sqrt=F.sqrt, radians=F.radians, degrees=F.degrees,
    wrapped=lambda lon: F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0),
    over=lambda x, y: F.try_divide(F.lit(x), y),
    capped=lambda x: F.when(x > 1.0, 1.0).when(x < -1.0, -1.0).otherwise(x),
)


def on_numbers(stages: Sequence[Stage], **start: float) -> Values:
    """The values after all stages, on plain numbers."""
    values = Values(**start)
    for stage in stages:
        vars(values).update(stage(NUMBERS, values))
    return values


def on_frame(
    df: DataFrame, stages: Sequence[Stage], start: Mapping[str, Column], to: Mapping[str, str]
) -> DataFrame:
    """``df`` with the columns ``to`` (column name by value name); each stage is a projection of its own."""
    prefix = "_p_"
    df = df.withColumns({f"{prefix}{name}": column for name, column in start.items()})
    known = list(start)
    for stage in stages:
        values = Values(**{name: F.col(f"{prefix}{name}") for name in known})
        found = stage(COLUMNS, values)
        df = df.withColumns({f"{prefix}{name}": column for name, column in found.items()})
        known += [name for name in found if name not in known]
    df = df.withColumns({column: F.col(f"{prefix}{name}") for name, column in to.items()})
    return df.drop(*[f"{prefix}{name}" for name in known])


def as_expression(stages: Sequence[Stage], names: Sequence[str], **start: Column) -> Column:
    """An array of the values ``names`` after all stages, as one expression."""

    def after(number: int, bound: Mapping[str, Column]) -> Column:
        if number == len(stages):
            return F.array(*[bound[name] for name in names])
        found = {**bound, **stages[number](COLUMNS, Values(**bound))}
        held = F.struct(*[column.alias(name) for name, column in found.items()])
        return F.transform(
            F.array(held), lambda s: after(number + 1, {name: s.getField(name) for name in found})
        )[0]

    return after(0, start)


def eccentricity(ellipsoid: Ellipsoid) -> float:
    f = 1.0 / ellipsoid[1]
    return math.sqrt(f * (2.0 - f))


def conformal_series(ellipsoid: Ellipsoid) -> tuple[float, ...]:
    """Coefficients of geodetic latitude from conformal latitude, in the third flattening."""
    f = 1.0 / ellipsoid[1]
    n = f / (2.0 - f)
    # Fixed values.
    return (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )


def _isometric(ops: Any, sin_lat: Any, e: float) -> Any:
    return ops.atanh(sin_lat) - ops.atanh(sin_lat * e) * e


def _from_conformal(ops: Any, chi: Any, ellipsoid: Ellipsoid) -> Any:
    lat = chi
    for j, c in enumerate(conformal_series(ellipsoid), start=1):
        lat = lat + ops.sin(chi * (2.0 * j)) * c
    return lat


def _latitude_stages(ellipsoid: Ellipsoid, side: float = 1.0) -> Sequence[Stage]:
    """Stages from ``t``, the exponential of the isometric latitude turned round, to ``lat``.

    The series comes first; each of two substitutions takes all but a 150th of what it left.
    """
    e = eccentricity(ellipsoid)

    def closer(ops: Any, v: Values) -> Mapping[str, Any]:
        part = ops.exp(ops.atanh(ops.sin(v.near) * e) * -e)
        return {"near": ops.atan2(v.t * part, 1.0) * -2.0 + math.pi / 2}

    return (
        lambda ops, v: {"chi": ops.atan2(v.t, 1.0) * -2.0 + math.pi / 2},
        lambda ops, v: {"near": _from_conformal(ops, v.chi, ellipsoid)},
        closer,
        closer,
        lambda ops, v: {"lat": ops.degrees(v.near) * side},
    )


class Projection:
    """Stages from ``lon, lat`` in degrees to ``x, y`` and back."""

    def forward(self) -> Sequence[Stage]:
        raise NotImplementedError

    def inverse(self) -> Sequence[Stage]:
        raise NotImplementedError


@dataclass(frozen=True)
class LambertConic(Projection):
    """Lambert conformal conic with two standard parallels."""

    origin: tuple[float, float]  # longitude, latitude
    parallels: tuple[float, float]
    false_easting: float
    false_northing: float
    ellipsoid: Ellipsoid = GRS80

    def _constants(self) -> tuple[float, float, float, float]:
        e = eccentricity(self.ellipsoid)

        def psi(lat: float) -> float:
            return _isometric(NUMBERS, math.sin(math.radians(lat)), e)

        def m(lat: float) -> float:
            s = math.sin(math.radians(lat))
            return math.cos(math.radians(lat)) / math.sqrt(1.0 - e * e * s * s)

        first, second = self.parallels
        n = (
            math.sin(math.radians(first))
            if first == second
            else (math.log(m(first)) - math.log(m(second))) / (psi(second) - psi(first))
        )
        scale = self.ellipsoid[0] * m(first) * math.exp(n * psi(first)) / n
        return e, n, scale, scale * math.exp(-n * psi(self.origin[1]))

    def forward(self) -> Sequence[Stage]:
        e, n, scale, radius = self._constants()
        return (
            lambda ops, v: {
                "sin": ops.sin(ops.radians(v.lat)),
                "turn": ops.radians(ops.wrapped(v.lon - self.origin[0])) * n,
            },
            lambda ops, v: {"r": ops.exp(_isometric(ops, v.sin, e) * -n) * scale},
            lambda ops, v: {
                "x": v.r * ops.sin(v.turn) + self.false_easting,
                "y": v.r * ops.cos(v.turn) * -1.0 + (self.false_northing + radius),
            },
        )

    def inverse(self) -> Sequence[Stage]:
        _, n, scale, radius = self._constants()
        sign = math.copysign(1.0, n)
        return (
            lambda ops, v: {
                "east": (v.x - self.false_easting) * sign,
                "north": (v.y * -1.0 + (self.false_northing + radius)) * sign,
            },
            lambda ops, v: {
                "t": ops.pow(ops.sqrt(v.east * v.east + v.north * v.north) / abs(scale), 1.0 / n)
            },
            lambda ops, v: {
                "lon": ops.wrapped(
                    ops.degrees(ops.atan2(v.east, v.north)) / n + self.origin[0]
                )
            },
            *_latitude_stages(self.ellipsoid),
        )


@dataclass(frozen=True)
class PolarStereographic(Projection):
    """Polar stereographic, by the scale at the pole or by the parallel of true scale."""

    north: bool
    meridian: float
    false_easting: float = 0.0
    false_northing: float = 0.0
    scale: float | None = None
    parallel: float | None = None
    ellipsoid: Ellipsoid = WGS84

    def _radius(self) -> float:
        """The distance from the pole at which the isometric latitude is zero."""
        a, e = self.ellipsoid[0], eccentricity(self.ellipsoid)
        if self.scale is not None:
            return 2 * a * self.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        s = math.sin(math.radians(abs(self.parallel)))
        m = math.cos(math.radians(self.parallel)) / math.sqrt(1 - e * e * s * s)
        return a * m * math.exp(_isometric(NUMBERS, s, e))

    def forward(self) -> Sequence[Stage]:
        e, radius = eccentricity(self.ellipsoid), self._radius()
        side = 1.0 if self.north else -1.0
        return (
            lambda ops, v: {
                "sin": ops.sin(ops.radians(v.lat)),
                "turn": ops.radians(v.lon - self.meridian),
            },
            lambda ops, v: {"r": ops.exp(_isometric(ops, v.sin, e) * -side) * radius},
            lambda ops, v: {
                "x": v.r * ops.sin(v.turn) + self.false_easting,
                "y": v.r * ops.cos(v.turn) * -side + self.false_northing,
            },
        )

    def inverse(self) -> Sequence[Stage]:
        radius, side = self._radius(), 1.0 if self.north else -1.0
        return (
            lambda ops, v: {
                "east": v.x - self.false_easting,
                "north": (v.y - self.false_northing) * -side,
            },
            lambda ops, v: {"t": ops.sqrt(v.east * v.east + v.north * v.north) / radius},
            lambda ops, v: {
                "lon": ops.wrapped(ops.degrees(ops.atan2(v.east, v.north)) + self.meridian)
            },
            *_latitude_stages(self.ellipsoid, side),
        )


@dataclass(frozen=True)
class LambertAzimuthal(Projection):
    """Lambert azimuthal equal area, oblique or polar."""

    origin: tuple[float, float]  # longitude, latitude
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def _q(self, ops: Any, s: Any, e: float) -> Any:
        return (s / (1.0 - s * s * (e * e)) + ops.atanh(s * e) / e) * (1.0 - e * e)

    def _constants(self) -> tuple[float, float, float, float, float, float]:
        a, e = self.ellipsoid[0], eccentricity(self.ellipsoid)
        pole = self._q(NUMBERS, 1.0, e)
        radius = a * math.sqrt(pole / 2)
        if abs(self.origin[1]) == 90.0:
            return e, pole, radius, 1.0, math.copysign(1.0, self.origin[1]), 0.0
        s = math.sin(math.radians(self.origin[1]))
        sin_b = self._q(NUMBERS, s, e) / pole
        cos_b = math.sqrt(1 - sin_b * sin_b)
        m = math.cos(math.radians(self.origin[1])) / math.sqrt(1 - e * e * s * s)
        return e, pole, radius, a * m / (radius * cos_b), sin_b, cos_b

    def forward(self) -> Sequence[Stage]:
        e, pole, radius, d, sin_b, cos_b = self._constants()
        return (
            lambda ops, v: {
                "sin": ops.sin(ops.radians(v.lat)),
                "turn": ops.radians(v.lon - self.origin[0]),
            },
            lambda ops, v: {
                "sb": ops.capped(self._q(ops, v.sin, e) / pole), "ct": ops.cos(v.turn)
            },
            lambda ops, v: {"cb": ops.sqrt(1.0 - v.sb * v.sb)},
            lambda ops, v: {
                "b": ops.sqrt(ops.over(2.0, 1.0 + v.sb * sin_b + v.cb * v.ct * cos_b)) * radius
            },
            lambda ops, v: {
                "x": v.b * v.cb * ops.sin(v.turn) * d + self.false_easting,
                "y": v.b * (v.sb * cos_b - v.cb * v.ct * sin_b) / d + self.false_northing,
            },
        )

    def inverse(self) -> Sequence[Stage]:
        e, pole, radius, d, sin_b, cos_b = self._constants()
        # Geodetic latitude from authalic latitude.
        series = (
            e**2 / 3 + 31 * e**4 / 180 + 517 * e**6 / 5040,
            23 * e**4 / 360 + 251 * e**6 / 3780,
            761 * e**6 / 45360,
        )

        def first(ops: Any, beta: Any) -> Any:
            lat = beta
            for j, c in enumerate(series, start=1):
                lat = lat + ops.sin(beta * (2.0 * j)) * c
            return lat

        return (
            lambda ops, v: {
                "east": (v.x - self.false_easting) / d,
                "north": (v.y - self.false_northing) * d,
            },
            # Half the chord over the radius, squared: no division by the distance from the origin.
            lambda ops, v: {"h": (v.east * v.east + v.north * v.north) / (4.0 * radius * radius)},
            lambda ops, v: {"k": ops.sqrt(1.0 - v.h) / radius, "cc": 1.0 - v.h * 2.0},
            lambda ops, v: {
                "sb": ops.capped(v.cc * sin_b + v.north * v.k * cos_b),
                "lon": ops.wrapped(
                    ops.degrees(
                        ops.atan2(v.east * v.k, v.cc * cos_b - v.north * v.k * sin_b)
                    )
                    + self.origin[0]
                ),
            },
            lambda ops, v: {"near": first(ops, ops.asin(v.sb))},
            lambda ops, v: {"s": ops.sin(v.near), "c": ops.cos(v.near)},
            # One step of Newton's rule takes the series' remainder; at a pole there is none.
            lambda ops, v: {
                "lat": ops.degrees(
                    v.near
                    + (v.sb * pole - self._q(ops, v.s, e))
                    * (1.0 - v.s * v.s * (e * e))
                    * (1.0 - v.s * v.s * (e * e))
                    * v.c
                    / ((v.c * v.c + 1e-30) * (2.0 * (1.0 - e * e)))
                )
            },
        )


@dataclass(frozen=True)
class Helmert:
    """Seven parameters from a datum to WGS84: metres, arc seconds, parts per million (position vector)."""

    shift: tuple[float, float, float]
    rotation: tuple[float, float, float]
    scale_ppm: float
    ellipsoid: Ellipsoid

    def geocentric_to_wgs84(self, x: float, y: float, z: float) -> tuple[float, float, float]:
        rx, ry, rz = (math.radians(r / 3600) for r in self.rotation)
        m = 1 + self.scale_ppm * 1e-6
        return (
            m * (x - rz * y + ry * z) + self.shift[0],
            m * (rz * x + y - rx * z) + self.shift[1],
            m * (-ry * x + rx * y + z) + self.shift[2],
        )

    def _moved(self, source: Ellipsoid, target: Ellipsoid, turned: Stage) -> Sequence[Stage]:
        e2 = eccentricity(source) ** 2
        a, f = target[0], 1.0 / target[1]
        b, own = a * (1 - f), f * (2 - f)
        return (
            lambda ops, v: {"sin": ops.sin(ops.radians(v.lat)), "cos": ops.cos(ops.radians(v.lat))},
            lambda ops, v: {"nu": source[0] / ops.sqrt(1.0 - v.sin * v.sin * e2)},
            lambda ops, v: {
                "gx": v.nu * v.cos * ops.cos(ops.radians(v.lon)),
                "gy": v.nu * v.cos * ops.sin(ops.radians(v.lon)),
                "gz": v.nu * v.sin * (1.0 - e2),
            },
            turned,
            lambda ops, v: {"p": ops.sqrt(v.hx * v.hx + v.hy * v.hy)},
            lambda ops, v: {"u": ops.atan2(v.hz * a, v.p * b)},
            lambda ops, v: {"su": ops.sin(v.u), "cu": ops.cos(v.u)},
            lambda ops, v: {
                "lon": ops.degrees(ops.atan2(v.hy, v.hx)),
                "lat": ops.degrees(
                    ops.atan2(
                        v.hz + v.su * v.su * v.su * (own / (1 - own) * b),
                        v.p - v.cu * v.cu * v.cu * (own * a),
                    )
                ),
            },
        )

    def to_wgs84(self) -> Sequence[Stage]:
        """Stages from ``lon, lat`` on the datum to ``lon, lat`` in WGS84; heights are zero."""
        rx, ry, rz = (math.radians(r / 3600) for r in self.rotation)
        m, (dx, dy, dz) = 1 + self.scale_ppm * 1e-6, self.shift
        return self._moved(
            self.ellipsoid,
            WGS84,
            lambda ops, v: {
                "hx": (v.gx - v.gy * rz + v.gz * ry) * m + dx,
                "hy": (v.gx * rz + v.gy - v.gz * rx) * m + dy,
                "hz": (v.gx * -ry + v.gy * rx + v.gz) * m + dz,
            },
        )

    def from_wgs84(self) -> Sequence[Stage]:
        """Stages from ``lon, lat`` in WGS84 to ``lon, lat`` on the datum."""
        rx, ry, rz = (math.radians(r / 3600) for r in self.rotation)
        m, (dx, dy, dz) = 1 + self.scale_ppm * 1e-6, self.shift

        def turned(ops: Any, v: Values) -> Mapping[str, Any]:
            x, y, z = (v.gx - dx) / m, (v.gy - dy) / m, (v.gz - dz) / m
            return {"hx": x + y * rz - z * ry, "hy": x * -rz + y + z * rx, "hz": x * ry - y * rx + z}

        return self._moved(WGS84, self.ellipsoid, turned)


#: The Finnish national datum of 1966.
KKJ = Helmert((-96.062, -82.428, -121.753), (4.801, 0.345, -1.376), 1.496, INTERNATIONAL)

#: Parameters of the systems by EPSG code.
PROJECTIONS: dict[int, Projection] = {
    # Lambert conformal conic
    2154: LambertConic((3.0, 46.5), (49.0, 44.0), 700000.0, 6600000.0),
    3034: LambertConic((10.0, 52.0), (35.0, 65.0), 4000000.0, 2800000.0),
    3301: LambertConic((24.0, 57.51755393055556), (59.0 + 1 / 3, 58.0), 500000.0, 6375000.0),
    # Lambert azimuthal equal area
    3035: LambertAzimuthal((10.0, 52.0), 4321000.0, 3210000.0),
    3571: LambertAzimuthal((180.0, 90.0), ellipsoid=WGS84),
    3572: LambertAzimuthal((-150.0, 90.0), ellipsoid=WGS84),
    3573: LambertAzimuthal((-100.0, 90.0), ellipsoid=WGS84),
    3574: LambertAzimuthal((-40.0, 90.0), ellipsoid=WGS84),
    3575: LambertAzimuthal((10.0, 90.0), ellipsoid=WGS84),
    3576: LambertAzimuthal((90.0, 90.0), ellipsoid=WGS84),
    6931: LambertAzimuthal((0.0, 90.0), ellipsoid=WGS84),
    6932: LambertAzimuthal((0.0, -90.0), ellipsoid=WGS84),
    # Polar stereographic
    3031: PolarStereographic(False, 0.0, parallel=-71.0),
    3032: PolarStereographic(False, 70.0, 6000000.0, 6000000.0, parallel=-71.0),
    3413: PolarStereographic(True, -45.0, parallel=70.0),
    3976: PolarStereographic(False, 0.0, parallel=-70.0),
    3995: PolarStereographic(True, 0.0, parallel=71.0),
    5041: PolarStereographic(True, 0.0, 2000000.0, 2000000.0, scale=0.994),
    5042: PolarStereographic(False, 0.0, 2000000.0, 2000000.0, scale=0.994),
    32661: PolarStereographic(True, 0.0, 2000000.0, 2000000.0, scale=0.994),
    32761: PolarStereographic(False, 0.0, 2000000.0, 2000000.0, scale=0.994),
}
