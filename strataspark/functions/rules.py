"""Value rules: ranges, dips, azimuth correction, colours, styles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

Rule = Callable[[Column], Column]

# Inclusive limits of valid readings, in degrees.
DIP_LIMITS = (0.0, 90.0)
AZIMUTH_LIMITS = (0.0, 360.0)
DECLINATION_LIMITS = (-360.0, 360.0)


def in_range(value: Column, low: float, high: float) -> Column:
    """True when ``low <= value <= high``; NULL and NaN are out.

    Spelled as a conjunction, which a filter can push into the scan.
    """
    return value.isNotNull() & value.between(low, high)


def valid_dip(value: Column) -> Column:
    """Dips and plunges lie in 0..90."""
    return in_range(value, *DIP_LIMITS)


def valid_azimuth(value: Column) -> Column:
    """Directions lie in 0..360."""
    return in_range(value, *AZIMUTH_LIMITS)


def column_rule(df: DataFrame, name: str, rule: Rule) -> Column:
    """Apply a numeric rule to a named column.

    A text column never passes: Spark would cast ``'45'`` to a number, while a
    reading stored as text is not a valid reading.
    """
    if not isinstance(df.schema[name].dataType, NumericType):
        return F.lit(False)
    return rule(F.col(name))


def correct_azimuth(azimuth: Column, declination: float | None) -> Column:
    """Add the declination to an azimuth and wrap the sum into 0..360.

    An azimuth outside 0..360 comes back unchanged, as does every azimuth when
    the declination is not a float in -360..360.  A sum of exactly 360 stays 360.
    Text is parsed; text that is no number becomes NULL.
    """
    number = azimuth.try_cast("double")
    usable = (
        isinstance(declination, float)
        and not math.isnan(declination)
        and DECLINATION_LIMITS[0] <= declination <= DECLINATION_LIMITS[1]
    )
    if not usable:
        return number
    turned = number + F.lit(declination)
    return (
        F.when(~in_range(number, *AZIMUTH_LIMITS), number)
        .when(turned > 360.0, turned - 360.0)
        .when(turned < 0.0, turned + 360.0)
        .otherwise(turned)
    )


def dip_colour(dip: Column) -> Column:
    """Steep dips red, medium green, the rest (and unknown) blue."""
    known = F.coalesce(~F.isnan(dip), F.lit(False))
    return (
        F.when(known & (dip > 60.0), "red").when(known & (dip > 30.0), "green").otherwise("blue")
    )


# Named layer styles.
LAYER_STYLES: dict[str, dict[str, str]] = {
    "Lineament": {"color": "black", "weight": "1"},
    "Bedrock": {"strokeColor": "blue", "fillOpacity": "0.0", "weight": "0.5"},
}


def style_map(style_name: Column) -> Column:
    """The style of a named layer as ``MAP<STRING, STRING>``; NULL when unnamed."""
    chosen = F.lit(None).cast("map<string,string>")
    for name, style in LAYER_STYLES.items():
        entries = [F.lit(part) for pair in style.items() for part in pair]
        chosen = F.when(style_name == name, F.create_map(*entries)).otherwise(chosen)
    return chosen


def recolour(style: Column, colour: Column) -> Column:
    """Give every style key that mentions a colour the value ``colour``.

    A NULL colour leaves the style as it is.
    """
    painted = F.transform_values(
        style, lambda key, value: F.when(F.lower(key).contains("color"), colour).otherwise(value)
    )
    return F.when(colour.isNull(), style).otherwise(painted)


def thumbnail_height(width: Column, height: Column, fixed_width: int) -> Column:
    """Height after scaling to ``fixed_width``, truncated.

    The order of operations decides the truncation, so it is kept:
    ``height * (fixed / width)``.
    """
    ratio = F.lit(float(fixed_width)) / width.cast("double")
    return (height.cast("double") * ratio).cast("int")
