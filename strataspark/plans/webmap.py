"""From source tables to the data of a web map."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators.layers import layer_specs, styled_features, to_geographic
from strataspark.operators.linking import Linker
from strataspark.operators.markers import (
    first_per_id,
    known_centre,
    markers,
    skipped_observations,
)
from strataspark.plans.export import (
    check_observations,
    check_run,
    check_typed,
    gather_observations,
    kept_linker,
    under_contract,
)
from strataspark.plans.rules import MapRules
from strataspark.sinks.markers import read_markers, write_layers, write_markers
from strataspark.sources.layers import read_documents
from strataspark.sources.paths import qualified


@dataclass(frozen=True)
class MapData:
    """Everything a map shows, and which observations it leaves out as repeated ids."""

    centre: tuple[float, float]
    markers: DataFrame
    layers: DataFrame | None
    skipped: DataFrame


def compile_markers(
    model: m.FieldModel,
    rules: MapRules,
    files: DataFrame | None = None,
    image_folder: str | None = None,
) -> DataFrame:
    """One marker per observation id of the selected observations."""
    first = first_per_id(gather_observations(model, rules))
    linker = Linker.over(model, first, rules.exceptions)
    return markers(linker, files, rules.rechecks, image_folder)


def compile_layers(
    features: DataFrame,
    specs: DataFrame,
    styles: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Extra layers in geographic coordinates, named and styled."""
    return styled_features(to_geographic(features), specs, styles)


def gather_layers(
    spark: SparkSession,
    datasets: Sequence[str],
    names: Sequence[str] = (),
    popup_fields: Sequence[str] = (),
    styles: Sequence[str] = (),
    colors: Sequence[str] = (),
    own_styles: Mapping[str, Mapping[str, str]] | None = None,
    read: Callable[[SparkSession, str], DataFrame] = read_documents,
) -> DataFrame:
    """Layers from the paths of their datasets to styled features.

    A dataset is a file or a folder of files, on any file system; its features
    belong to it because they were read from it, not because paths compare equal.
    One without features raises.
    """
    specs = layer_specs(spark, datasets, names, popup_fields, styles, colors, own_styles or ())
    parts = []
    for dataset in datasets:
        found = read(spark, qualified(spark, dataset)).withColumn("dataset", F.lit(dataset))
        if found.isEmpty():
            raise ValueError(f"{dataset} has no features")
        own = specs.where(F.col("position") == len(parts))
        parts.append(compile_layers(found, own, own_styles))
    return reduce(DataFrame.unionByName, parts)


def compile_webmap(
    spark: SparkSession,
    model: m.FieldModel,
    rules: MapRules,
    folder: str,
    projects: Iterable[str] = (),
    files: DataFrame | None = None,
    image_folder: str | None = None,
    datasets: Sequence[str] = (),
    names: Sequence[str] = (),
    popup_fields: Sequence[str] = (),
    styles: Sequence[str] = (),
    colors: Sequence[str] = (),
    own_styles: Mapping[str, Mapping[str, str]] | None = None,
    read_layer: Callable[[SparkSession, str], DataFrame] = read_documents,
    contract: str = "fail",
) -> MapData:
    """Compile and write markers and layers; no observation raises.

    ``datasets`` and what follows it are as for :func:`gather_layers`.
    ``contract`` is as for :func:`~.export.export_observations`, and covers
    pictures' ids and captions when there are files to match.
    """
    merged = rules.with_projects(list(projects))
    checked = under_contract(model, contract)
    selected = gather_observations(checked, merged)
    at = known_centre(selected)
    if contract == "fail":
        # All selected observations, not only the first of each id.
        check_observations(selected)
    with kept_linker(checked, merged, first_per_id(selected)) as linker:
        if contract == "fail":
            check_run(linker, with_images=files is not None)
            check_typed(linker, merged)
        write_markers(markers(linker, files, merged.rechecks, image_folder), folder)
    styled = None
    if datasets:
        styled = gather_layers(
            spark, datasets, names, popup_fields, styles, colors, own_styles, read_layer
        )
        write_layers(styled, folder)
    return MapData(at, read_markers(spark, folder), styled, skipped_observations(selected))
