"""Linking picture ids to files, and thumbnails."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.rules import thumbnail_height
from strataspark.functions.text import base_name, stem
from strataspark.session import cut_lineage, fits_broadcast, likely_in


# Workers need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Leading characters by which substrings that can be no id are left out early.
_PREFIX = 4


def match_files(ids: DataFrame, files: DataFrame, id_column: str = "PICTURE_ID") -> DataFrame:
    """Which file belongs to each picture id.

    An id belongs to a file when the file's stem contains it.  Returns one row
    per distinct id that any file contains: ``id_column, n_files, path`` with
    ``path`` only where exactly one file matches.

    Each stem is cut into its distinct substrings of the lengths that ids have,
    so containment becomes equality.  Substrings are counted before they meet
    the ids: one that a large part of all files share is reduced map-side to
    one row.  Files are carried as a number and looked up again for single
    matches, where containment also settles equal numbers.  An empty id is the
    empty substring of every stem.
    """
    # Written once, as several steps ask for them and what leads to them may be long.
    distinct_ids = cut_lineage(ids.select(id_column).where(F.col(id_column).isNotNull()).distinct())
    # Cutting multiplies rows, so partitions stay as many as a shuffle's even
    # where the paths themselves would fit in fewer.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stems = (
        files.select("path")
        .repartition(parts, "path")
        .distinct()
        .select("path", stem(F.col("path")).alias("_stem"), F.xxhash64("path").alias("_file"))
    )
    counted = (
        _candidates(stems, distinct_ids, id_column)
        .groupBy(id_column)
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("_file").alias("_file"))
    )
    single = F.when(F.col("n_files") == 1, F.col("_file")).alias("_single")
    matched = distinct_ids.join(counted, id_column).select(id_column, "n_files", single)
    same = (F.col("_single") == F.col("_file")) & F.col("_stem").contains(F.col(id_column))
    return matched.join(stems, same, "left").select(id_column, "n_files", "path")


def _candidates(stems: DataFrame, distinct_ids: DataFrame, id_column: str) -> DataFrame:
    """Distinct substrings of each stem that can be an id, with the file.

    When lengths and leading characters of all ids are few enough to broadcast,
    substrings that begin like no id are dropped where they are cut.
    """
    shapes = distinct_ids.select(
        F.length(id_column).alias("_length"),
        F.substring(id_column, 1, _PREFIX).alias("_prefix"),
    ).distinct()
    # A scalar subquery: at most as many lengths as a stem has characters.
    lengths = shapes.agg(F.collect_set("_length").alias("lengths")).scalar()
    length, at = F.col("_length"), F.col("_at")
    cut = (
        stems.select("_file", "_stem", F.explode(lengths).alias("_length"))
        .where(length <= F.length("_stem"))
        .withColumn(
            "_at",
            F.explode(F.sequence(F.lit(1), F.greatest(F.length("_stem") - length + 1, F.lit(1)))),
        )
        .where((length > 0) | (at == 1))
    )
    if fits_broadcast(shapes):
        prefix = F.substr(F.col("_stem"), at, F.least(length, F.lit(_PREFIX)))
        cut = cut.withColumn("_prefix", prefix).join(
            F.broadcast(shapes), ["_length", "_prefix"], "left_semi"
        )
    text = F.substr(F.col("_stem"), at, length)
    # The first occurrence in a stem stands for all of them.
    found = cut.select("_file", "_stem", "_at", text.alias(id_column)).where(
        (F.expr(f"instr(_stem, `{id_column}`)") == at) | (F.col(id_column) == "")
    )
    # Most substrings are no id and need not meet the ids.
    return likely_in(found, [id_column], distinct_ids, distinct_ids.count())


def link_files(images: DataFrame, files: DataFrame, id_column: str = "PICTURE_ID") -> DataFrame:
    """Image rows with ``n_files`` and ``path``; no match counts zero."""
    matched = match_files(images, files, id_column)
    return images.join(matched, id_column, "left").withColumn(
        "n_files", F.coalesce(F.col("n_files"), F.lit(0).cast("long"))
    )


# Outcomes for one image of a resize run.
RESIZE, EXISTS, INVALID = "resize", "exists", "invalid"


def missing_targets(origin: DataFrame, destination: DataFrame) -> DataFrame:
    """Images without a file of the same name at the destination."""
    done = destination.select(base_name(F.col("path")).alias("name"))
    return origin.withColumn("name", base_name(F.col("path"))).join(done, "name", "left_anti")


def resize_manifest(
    origin: DataFrame,
    destination: DataFrame,
    fixed_width: int = 800,
    extension: str = "jpg",
    overwrite: bool = False,
) -> DataFrame:
    """What a resize run does with each image of ``path, width, height``.

    ``name, path, status, new_width, new_height``.  An existing target is left
    alone unless ``overwrite``; an image without a valid size is skipped.
    """
    named = origin.where(F.col("path").endswith(f".{extension}")).withColumn(
        "name", base_name(F.col("path"))
    )
    done = (
        destination.select(base_name(F.col("path")).alias("name"))
        .distinct()
        .withColumn("_done", F.lit(True))
    )
    exists = F.coalesce(F.col("_done"), F.lit(False)) & F.lit(not overwrite)
    valid = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    status = F.when(exists, EXISTS).when(~valid, INVALID).otherwise(RESIZE)
    resized = status == RESIZE
    return named.join(done, "name", "left").select(
        "name",
        "path",
        status.alias("status"),
        F.when(resized, F.lit(fixed_width)).alias("new_width"),
        F.when(resized, thumbnail_height(F.col("width"), F.col("height"), fixed_width)).alias(
            "new_height"
        ),
    )


def nearest_indices(old: int, new: int) -> np.ndarray:
    """Source index of each target position: the pixel under its centre."""
    at = np.floor((np.arange(new) + 0.5) * old / new).astype(np.int64)
    return np.minimum(at, old - 1)


def resample(images: DataFrame, fixed_width: int = 800) -> DataFrame:
    """Nearest-neighbour thumbnails of decoded images.

    Input rows are ``path, width, height, channels, data`` as Spark's image
    reader decodes them; output has the same columns at the new size.  Rows are
    independent, so the work spreads with the input's partitions and no image
    needs another.
    """
    sized = images.where(F.col("width") > 0).withColumn(
        "_height", thumbnail_height(F.col("width"), F.col("height"), fixed_width)
    )

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for row in batch.itertuples(index=False):
                pixels = np.frombuffer(row.data, dtype=np.uint8)
                pixels = pixels.reshape(row.height, row.width, row.channels)
                rows = nearest_indices(row.height, row[-1])
                columns = nearest_indices(row.width, fixed_width)
                data.append(pixels[rows][:, columns].tobytes())
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "width": fixed_width,
                    "height": batch["_height"],
                    "channels": batch["channels"],
                    "data": data,
                }
            )

    columns = ["path", "width", "height", "channels", "data", "_height"]
    schema = "path string, width int, height int, channels int, data binary"
    return sized.select(*columns).mapInPandas(shrink, schema)
