"""Writing map markers and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.layers import geojson_lines


def marker_lines(markers: DataFrame) -> DataFrame:
    """One GeoJSON feature per marker as ``value``; keeps ``PROJECT``."""
    shown = F.struct("tooltip", "icon", "color", "angle", "popup")
    return markers.select(
        "PROJECT",
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            F.to_json(shown, {"ignoreNullFields": "false"}),
            F.lit(',"geometry":{"type":"Point","coordinates":'),
            F.to_json(F.array("LON", "LAT")),
            F.lit("}}"),
        ).alias("value"),
    )


MARKER_SCHEMA = (
    "OBSID string, PROJECT string, LAT double, LON double, tooltip string, icon string, "
    "color string, angle double, popup string"
)


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Markers written by :func:`write_markers`."""
    return spark.read.schema(MARKER_SCHEMA).parquet(f"{folder}/markers.parquet")


def write_markers(markers: DataFrame, folder: str) -> None:
    """Markers as Parquet and as GeoJSON lines, both by project.

    The lines are made from the written markers, so these are compiled once.
    """
    stored = f"{folder}/markers.parquet"
    # One writer per project, or several where a project is large; not one per task and project.
    dealt = markers.hint("rebalance", "PROJECT")
    dealt.write.mode("overwrite").partitionBy("PROJECT").parquet(stored)
    written = read_markers(markers.sparkSession, folder)
    marker_lines(written).write.mode("overwrite").partitionBy("PROJECT").text(
        f"{folder}/markers.geojson"
    )


def write_layers(features: DataFrame, folder: str) -> None:
    """Styled features as GeoJSON lines."""
    geojson_lines(features).write.mode("overwrite").text(f"{folder}/layers.geojson")
