"""What the operators of this package share: reading, held-out rows, label samples."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers get these functions with their code; they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A key is frequent when it holds one in so many rows.
FREQUENT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text``; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def remainder(column: str, by: int) -> F.Column:
    """crc32 of an id written as text, modulo ``by``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def is_held_out(column: str, by: int, part: int = 2) -> F.Column:
    """Whether a row is kept out of learning; a row without an id never teaches either."""
    return F.coalesce(remainder(column, by) == part, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, by: int = 4
) -> DataFrame:
    """At most ``limit`` labelled ``(doc_id, text, label)`` rows that may be learned from.

    Ids are chosen by hash, so the choice does not depend on partitions.  Contradicting
    labels of one id give the larger one; null labels and ids are left out.  The chosen
    ids, bounded by ``limit``, are broadcast.  Of rows that repeat an id the least text
    teaches; they are reduced map-side, however many they are.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & (remainder("doc_id", by) != 2))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(
        "doc_id", "text", "label"
    )


def looked_up(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row per ``key``.

    ``weight`` says how many rows have a key, out of ``total``.  Keys that hold one in ``FREQUENT``
    rows or more, of which there can be ``FREQUENT``, are broadcast; the others are joined by a
    shuffle.
    """
    hot = F.col(weight) * FREQUENT >= max(total, 1)
    often = values.where(hot).drop(weight).withColumn("_often", F.lit(True))
    tagged = rows.join(F.broadcast(often), key, "left")
    rest = tagged.where("_often is null").select(*rows.columns)
    return (
        tagged.where("_often")
        .drop("_often")
        .unionByName(rest.join(values.where(~hot).drop(weight), key))
    )


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver that only waits rarely does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def worker_store(name: str, make: Callable[[], object]) -> object:
    """An object kept by a Python worker from one task to the next.

    Functions sent by value get new globals for each task, so the object lives in a module
    entry of its own.
    """
    module = sys.modules.setdefault("_strataspark_worker", types.ModuleType("_strataspark_worker"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def forget_stores() -> None:
    """Let go of what a worker has kept for the tasks of other operators."""
    sys.modules.pop("_strataspark_worker", None)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, one behind the other, and where each text begins."""
    own = texts.cast(pa.binary())
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    data = own.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1].astype(np.int64) - offsets[0]


def byte_ranges(
    data: np.ndarray, begins: np.ndarray, apart: np.ndarray, size: int
) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that cut no word; ``apart`` marks the bytes between words."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        if to < len(data):
            following = np.searchsorted(begins, to)
            end = int(begins[following]) if following < len(begins) else len(data)
            while to < end:
                found = np.flatnonzero(apart[data[to : min(to + 4096, end)]])
                if len(found):
                    to += int(found[0])
                    break
                to = min(to + 4096, end)
        yield at, to
        at = to


def words_in(
    part: np.ndarray, begins: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the words of some bytes start, and the words by number; texts begin at ``begins``."""
    inside = ~apart[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(part)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    offsets = np.cumsum(inside, dtype=np.int32)
    ends = np.append(offsets[starts] - 1, offsets[-1:]).astype(np.int32)
    letters = np.ascontiguousarray(part[inside])
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]
    )
    return starts, words.dictionary_encode()
