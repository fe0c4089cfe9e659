"""Choosing observations: by project, by box, with their coordinates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.functions import geo
from strataspark.plans.rules import Bounds, MapRules


def in_projects(observations: DataFrame, projects: Iterable[str]) -> DataFrame:
    """Observations of the given projects, compared exactly.

    No project selects nothing; an observation without one is never selected.
    """
    return observations.where(F.col("PROJECT").isin(list(projects)))


def in_project_table(observations: DataFrame, projects: DataFrame) -> DataFrame:
    """As :func:`in_projects`, with the names as rows of a ``PROJECT`` column."""
    return observations.join(projects.select("PROJECT"), "PROJECT", "left_semi")


def within_bounds(observations: DataFrame, bounds: Bounds, epsg: int) -> DataFrame:
    """Observations inside a box of a projected system, edges included.

    Adds the point as ``x, y``.  A longitude/latitude envelope of the box goes
    first: it reaches the scan's row-group statistics, which the exact test on
    computed coordinates cannot, and spares the series for rows far away.
    """
    envelope = geo.geographic_envelope(bounds, epsg)
    if envelope is not None:
        west, south, east, north = envelope
        observations = observations.where(
            F.col("LAT").between(south, north) & F.col("LON").between(west, east)
        )
    return geo.keep_in_box(geo.with_projected(observations, epsg), bounds)


def select_observations(observations: DataFrame, rules: MapRules) -> DataFrame:
    """Project filter, then the box when one is set; columns stay as they are."""
    return with_coordinates(observations, rules).drop("x", "y", "z")


def with_coordinates(observations: DataFrame, rules: MapRules) -> DataFrame:
    """Selected observations with ``x, y, z`` in the export system.

    ``z`` is the constant zero.  A box in the export system already computed
    the point.
    """
    chosen = in_projects(observations, rules.projects)
    bounded = rules.bounds is not None and rules.bounds_epsg is not None
    if bounded:
        chosen = within_bounds(chosen, rules.bounds, rules.bounds_epsg)
    if not bounded or rules.bounds_epsg != geo.EXPORT_EPSG:
        chosen = geo.with_projected(chosen, geo.EXPORT_EPSG)
    return chosen.withColumn("z", F.lit(0.0))


def observation_keys(observations: DataFrame) -> DataFrame:
    """Rename an observation's identity so that child rows can keep theirs."""
    return observations.select(
        m.SRC,
        F.col(m.RID).alias(m.OBS_RID),
        "OBSID",
        F.col("REMARKS").alias("OBS_REMARKS"),
        "PROJECT",
        *[c for c in ("LAT", "LON", "x", "y", "z") if c in observations.columns],
    )
