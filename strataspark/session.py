"""Session defaults, durable scratch space and checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")

# A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes charged per fixed-width value and per row when measuring a side.
_VALUE_BYTES = 16


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataspark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Checkpoints that nothing refers to any more are removed.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Only a session that names none (tests, a laptop) gets a folder of its own.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="strataspark-")
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to durable storage and go on from what was written."""
    durable_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_COALESCE_KEPT = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept in memory, then on disk, in as many partitions as its size asks for.

    Spark leaves what it keeps in all partitions of its last shuffle unless told otherwise, and every
    following scan pays for each of them.
    """
    conf = df.sparkSession.conf
    before = conf.get(_COALESCE_KEPT)
    conf.set(_COALESCE_KEPT, "true")
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(_COALESCE_KEPT, before)


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders with many folders are listed by a few tasks a core, where Spark takes one for each."""
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` in one aggregate and tell whether it may be broadcast."""
    return measured(df)[0] <= limit_bytes


def measured(df: DataFrame) -> tuple[int, int]:
    """The bytes and rows of ``df``, in one aggregate."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    fixed = _VALUE_BYTES * (1 + len(df.columns))
    row_bytes = F.lit(fixed).cast("long")
    for name in strings:
        row_bytes = row_bytes + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    return tuple(df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)), F.count(F.lit(1))).first())


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows one.

    Beyond the limit the DataFrame comes back unhinted and joins shuffle, where
    adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if fits_broadcast(df, limit_bytes) else df


# A filter of keys has up to this many bits, a million words of 64.
FILTER_BITS = 1 << 26
_WORD = 64


def likely_in(
    df: DataFrame, on: Sequence[str], keys: DataFrame, count: int, key_columns: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``df`` whose ``on`` is among the keys, and some others, before a shuffle.

    Each key sets one of eight bits or more, and the bits are sent to all tasks in words, so that a
    following join moves few rows that match nothing; what it returns stays the same.  ``count`` is
    about how many keys there are: beyond eight million the filter lets more rows pass, and for half
    as many keys as bits it is left out.  ``key_columns`` names the keys' columns where they differ.
    """
    words = filter_words(keys, key_columns or on, count)
    return df if words is None else through_filter(df, on, words, count)


def _filter_place(columns: Sequence[str], count: int) -> Column:
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * count).bit_length()))
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def filter_words(keys: DataFrame, on: Sequence[str], count: int) -> DataFrame | None:
    """The filter of :func:`likely_in` for some keys; None where it is left out."""
    if count > FILTER_BITS // 2:
        return None
    return (
        keys.select(_filter_place(on, count).alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("_word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_at % {_WORD} as int))")).alias("_bits"))
    )


def through_filter(
    df: DataFrame, on: Sequence[str], words: DataFrame, count: int
) -> DataFrame:
    """The rows of ``df`` that a filter from :func:`filter_words` over ``count`` keys lets pass."""
    placed = df.withColumn("_at", _filter_place(on, count)).withColumn("_word", F.shiftright("_at", 6))
    bit = F.expr(f"shiftrightunsigned(_bits, cast(_at % {_WORD} as int)) & 1")
    return placed.join(F.broadcast(words), "_word").where(bit == 1).select(*df.columns)


def run_together(
    spark: SparkSession, jobs: Mapping[str, Callable[[], Result]]
) -> dict[str, Result]:
    """Submit independent jobs at once, so that one's last tasks overlap the next.

    Results by name; the first failure is raised after all have ended.
    """
    if not jobs:
        return {}
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        running = {name: pool.submit(inherit(job)) for name, job in jobs.items()}
    return {name: job.result() for name, job in running.items()}
