"""GeoJSON layers as feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.layers import epsg_code, vertices
from strataspark.sources.paths import decoded

_GEOMETRY = "struct<type: string, coordinates: string>"
_FEATURE = f"struct<type: string, properties: map<string,string>, geometry: {_GEOMETRY}>"
_CRS = "struct<type: string, properties: struct<name: string>>"
_DOCUMENT = f"struct<type: string, crs: {_CRS}, features: array<{_FEATURE}>>"
_LINE = f"struct<type: string, crs: {_CRS}, properties: map<string,string>, geometry: {_GEOMETRY}>"


def _feature_columns(feature: Column) -> list[Column]:
    kind = feature["geometry"]["type"]
    return [
        kind.alias("geometry_type"),
        vertices(kind, feature["geometry"]["coordinates"]).alias("vertices"),
        feature["properties"].alias("properties"),
    ]


def parse_documents(documents: DataFrame) -> DataFrame:
    """Feature rows of whole documents ``dataset, text``.

    ``dataset, feature_no, epsg, geometry_type, vertices, properties``.
    """
    parsed = documents.select("dataset", F.from_json("text", _DOCUMENT).alias("d"))
    return parsed.select(
        "dataset",
        epsg_code(F.col("d.crs.properties.name")).alias("epsg"),
        F.posexplode("d.features").alias("feature_no", "f"),
    ).select(
        "dataset",
        F.col("feature_no").cast("long").alias("feature_no"),
        "epsg",
        *_feature_columns(F.col("f")),
    )


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GeoJSON documents; one file is one task, many files spread."""
    texts = spark.read.text(path, wholetext=True)
    return parse_documents(
        texts.select(decoded(F.col("_metadata.file_path")).alias("dataset"), F.col("value").alias("text"))
    )


def read_lines(spark: SparkSession, path: str | list[str], epsg: int = 4326) -> DataFrame:
    """Large layers written with one feature per line.

    Files are split like any text, so one large file spreads over many tasks.
    Every line is parsed; what matters is its ``type``, not how it begins.  A line
    may start with a record separator and end with a comma.  Lines of a document's
    frame are left out; a line that names a feature and does not parse as one raises.
    ``epsg`` holds for features without a ``crs`` of their own.  Features are
    numbered by their byte order only inside a split, so ``feature_no`` is NULL.
    """
    line = F.regexp_replace("value", r"^[\s\x{1E}]+|[\s,]+$", "")
    parsed = spark.read.text(path).select(
        decoded(F.col("_metadata.file_path")).alias("dataset"),
        line.alias("line"),
        F.from_json(line, _LINE).alias("f"),
    )
    is_feature = F.coalesce(F.col("f.type") == "Feature", F.lit(False))
    cut = ~is_feature & F.col("line").rlike(r'"type"\s*:\s*"Feature"')
    message = F.concat(F.lit("a feature is not on one line in "), F.col("dataset"))
    features = parsed.where(is_feature | cut).select(
        "dataset", F.when(cut, F.raise_error(message).cast(_LINE)).otherwise(F.col("f")).alias("f")
    )
    own = epsg_code(F.col("f.crs.properties.name"))
    return features.select(
        "dataset",
        F.lit(None).cast("long").alias("feature_no"),
        F.when(F.col("f.crs").isNull(), F.lit(epsg)).otherwise(own).alias("epsg"),
        *_feature_columns(F.col("f")),
    )
