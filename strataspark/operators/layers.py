"""Extra map layers: specifications, features, styles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.functions.rules import LAYER_STYLES, recolour, style_map
from strataspark.functions.text import stem
from strataspark.sources.paths import plain

SPEC_SCHEMA = (
    "position int, dataset string, name string, popup_field string, style string, color string"
)

# How deep each geometry type nests its vertices below four levels.
_DEPTH = {
    "Point": 3,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 1,
    "Polygon": 1,
    "MultiPolygon": 0,
}
_NESTED = "array<" * 4 + "double" + ">" * 4


def layer_specs(
    spark: SparkSession,
    datasets: Sequence[str],
    names: Sequence[str] = (),
    popup_fields: Sequence[str] = (),
    styles: Sequence[str] = (),
    colors: Sequence[str] = (),
    own_styles: Iterable[str] = (),
) -> DataFrame:
    """Layer arguments paired by position; one row per given dataset.

    ``own_styles`` names the caller's styles beside the known ones.
    """
    allowed = {*LAYER_STYLES, *own_styles}
    unknown = [s for s in styles if s is not None and s not in allowed]
    if unknown:
        raise ValueError(f"unknown styles {unknown}; known are {sorted(allowed)}")
    if datasets and max(map(len, (names, popup_fields, styles, colors))) > len(datasets):
        raise ValueError("more layer attributes than datasets")
    rows = [
        (i, *values)
        for i, values in enumerate(zip_longest(datasets, names, popup_fields, styles, colors))
        if datasets
    ]
    return named_by_stem(spark.createDataFrame(rows, SPEC_SCHEMA))


def pair_by_position(datasets: DataFrame, **attributes: DataFrame) -> DataFrame:
    """As :func:`layer_specs` over tables of ``position, value``.

    A position without a dataset stays in the result with ``status``
    ``no_dataset``, so that nothing given is lost unseen.
    """
    paired = datasets.select("position", F.col("value").alias("dataset"))
    for name, values in attributes.items():
        paired = paired.join(
            values.select("position", F.col("value").alias(name)), "position", "full_outer"
        )
    status = F.when(F.col("dataset").isNull(), "no_dataset").otherwise("ok")
    return named_by_stem(paired.withColumn("status", status))


def named_by_stem(specs: DataFrame) -> DataFrame:
    """Name layers without a name after their file."""
    return specs.withColumn("name", F.coalesce("name", stem(F.col("dataset"))))


def epsg_code(crs_name: Column) -> Column:
    """EPSG code of a CRS name; no CRS and CRS84 mean geographic."""
    code = F.regexp_extract(crs_name, r"EPSG:.*?(\d+)$", 1)
    return (
        F.when(crs_name.isNull() | crs_name.contains("CRS84"), F.lit(geo.GEOGRAPHIC_EPSG))
        .when(code != "", code.cast("int"))
        .otherwise(F.lit(None))
    )


def vertices(geometry_type: Column, coordinates: Column) -> Column:
    """Coordinate text to vertices nested four deep, whatever the type.

    Types without vertices of their own (collections) give NULL.
    """
    nested = F.lit(None).cast(_NESTED)
    for name, missing in _DEPTH.items():
        parsed = F.from_json(
            coordinates, "array<" * (4 - missing) + "double" + ">" * (4 - missing)
        )
        for _ in range(missing):
            parsed = F.array(parsed)
        nested = F.when(geometry_type == name, parsed).otherwise(nested)
    return nested


def unnested(geometry_type: Column, nested: Column) -> Column:
    """Vertices back to coordinate text at the type's own depth."""
    text = F.lit(None).cast("string")
    for name, missing in _DEPTH.items():
        own = nested
        for _ in range(missing):
            own = own[0]
        text = F.when(geometry_type == name, F.to_json(own)).otherwise(text)
    return text


def _each_vertex(nested: Column, change: Callable[[Column], Column]) -> Column:
    def at(depth: int) -> Callable[[Column], Column]:
        if depth == 0:
            return change
        return lambda items: F.transform(items, at(depth - 1))

    return at(3)(nested)


def _unproject_from(code: int) -> Callable[[Column], Column]:
    return lambda vertex: geo.unproject(vertex[0], vertex[1], code)


def to_geographic(features: DataFrame, codes: Iterable[int] | None = None) -> DataFrame:
    """Bring ``vertices`` of ``epsg`` into EPSG:4326.

    ``codes`` are the systems that occur; left out, they are looked up (there
    are at most as many as supported systems).  Others raise.
    """
    if codes is None:
        codes = [r[0] for r in features.select("epsg").distinct().collect()]
    found = list(codes)
    if None in found:
        raise ValueError("a layer names a coordinate system that is not an EPSG code")
    changed = F.lit(None).cast(_NESTED)
    for code in sorted(found):
        geo.check_epsg(code)
        moved = _each_vertex(F.col("vertices"), _unproject_from(code))
        changed = F.when(F.col("epsg") == code, moved).otherwise(changed)
    return features.withColumns({"vertices": changed, "epsg": F.lit(geo.GEOGRAPHIC_EPSG)})


def styled_features(
    features: DataFrame, specs: DataFrame, styles: Mapping[str, Mapping[str, str]] | None = None
) -> DataFrame:
    """Features with their layer's name, style and popup.

    ``features`` carry ``dataset`` as the specifications name it; a local path
    and its ``file:`` form are the same.  ``styles`` adds named styles of the
    caller's own to the known ones.  An absent or empty popup field gives no popup.
    """
    known = style_map(F.col("style"))
    for name, values in (styles or {}).items():
        own = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        known = F.when(F.col("style") == name, own).otherwise(known)
    style = recolour(known, F.col("color"))
    field = F.nullif("popup_field", F.lit(""))
    features = features.withColumn("dataset", plain(F.col("dataset")))
    specs = specs.withColumn("dataset", plain(F.col("dataset")))
    return features.join(specs, "dataset").select(
        "position",
        "dataset",
        "name",
        "feature_no",
        style.alias("style"),
        F.when(field.isNotNull(), F.col("properties")[field]).alias("popup"),
        "geometry_type",
        "vertices",
        "properties",
    )


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as ``value``."""
    geometry = F.concat(
        F.lit('{"type":"'),
        F.col("geometry_type"),
        F.lit('","coordinates":'),
        unnested(F.col("geometry_type"), F.col("vertices")),
        F.lit("}"),
    )
    shown = F.struct("name", "style", "popup", "properties")
    return features.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            F.to_json(shown, {"ignoreNullFields": "false"}),
            F.lit(',"geometry":'),
            F.coalesce(geometry, F.lit("null")),
            F.lit("}"),
        ).alias("value")
    )
