"""Batch thumbnails of an image folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import base_name
from strataspark.operators.images import missing_targets, resample, resize_manifest
from strataspark.session import broadcast_if_small
from strataspark.sources.images import read_images


def resize_images(
    spark: SparkSession,
    origin: str,
    destination: str,
    done: DataFrame,
    fixed_width: int = 800,
    extension: str = "jpg",
    overwrite: bool = False,
) -> DataFrame:
    """Resample every image that still needs it; returns the manifest.

    ``done`` lists (as ``path``) the images that exist at the destination.
    Pixels are appended to Parquet at ``destination`` with the ``run`` that made
    them, and :func:`stored_thumbnails` reads the newest of each name; so
    ``overwrite`` replaces the names of this run and no others.  Images are
    decoded once for this; while the names that exist are few enough to
    broadcast, pixels are never shuffled.
    """
    images = read_images(spark, origin, extension)
    manifest = resize_manifest(
        images.select("path", "width", "height"), done, fixed_width, extension, overwrite
    )
    if overwrite:
        todo = images.withColumn("name", base_name(F.col("path")))
    else:
        todo = missing_targets(images, broadcast_if_small(done.select("path")))
    pixels = resample(todo, fixed_width)
    run = time.time_ns() // 1000
    named = pixels.withColumns({"name": base_name(F.col("path")), "run": F.lit(run)})
    named.write.mode("append").parquet(destination)
    return manifest


def stored_thumbnails(spark: SparkSession, destination: str) -> DataFrame:
    """The newest thumbnail of each name; only names and runs are compared, not pixels."""
    stored = spark.read.parquet(destination)
    newest = stored.groupBy("name").agg(F.max("run").alias("run"))
    return stored.join(newest, ["name", "run"], "left_semi")
