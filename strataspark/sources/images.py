"""Image folders: listings without content, and decoded images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_images(spark: SparkSession, folder: str, extension: str = "jpg") -> DataFrame:
    """Files of one folder as ``path, length``; the content is never read.

    Not recursive; the extension is case-sensitive.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{extension}")
        .load(folder)
        .select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "length")
    )


def read_images(spark: SparkSession, folder: str, extension: str = "jpg") -> DataFrame:
    """Decoded images as ``path, width, height, channels, data``.

    A file that is no image stays as a row of width -1, for the manifest to
    report.
    """
    return (
        spark.read.format("image")
        .option("pathGlobFilter", f"*.{extension}")
        .load(folder)
        .select(
            F.regexp_replace("image.origin", r"^file:/*", "/").alias("path"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.col("image.nChannels").alias("channels"),
            F.col("image.data").alias("data"),
        )
    )
