"""Point datasets: one row per child row, with its observation's attributes."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.functions.rules import (
    Rule,
    column_rule,
    correct_azimuth,
    valid_azimuth,
    valid_dip,
)
from strataspark.operators.linking import Linker
from strataspark.session import cut_lineage

log = logging.getLogger(__name__)

VALIDITY_RULES: dict[str, dict[str, Rule]] = {
    m.PLANARS: {"DIP": valid_dip, "DIRECTION_OF_DIP": valid_azimuth},
    m.LINEARS: {"PLUNGE": valid_dip, "DIRECTION": valid_azimuth},
}


def subset(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns; no name means all.  A missing one raises."""
    wanted = list(columns)
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} not among {df.columns}")
    return df.select(*wanted) if wanted else df


def with_observation_remarks(df: DataFrame) -> DataFrame:
    """Name the observation's remark by what the child leaves free.

    A child with remarks of its own keeps them and the observation's become
    ``OBS_REMARKS``; otherwise they become ``REMARKS``.
    """
    return df if "REMARKS" in df.columns else df.withColumnRenamed("OBS_REMARKS", "REMARKS")


def correct_azimuths(df: DataFrame, declination: float | None) -> DataFrame:
    """Apply the declination to every azimuth column present."""
    present = [c for c in m.AZIMUTH_COLUMNS if c in df.columns]
    return df.withColumns({c: correct_azimuth(F.col(c), declination) for c in present})


def type_points(linker: Linker, kind: str, declination: float | None) -> DataFrame:
    """One exported dataset before the validity filter.

    Child columns, then ``OBSID``, remarks, ``PROJECT`` and ``x, y, z``; row
    identity and order stay in underscore columns until a sink drops them.
    """
    rows = with_observation_remarks(linker.of_type(kind))
    remarks = "OBS_REMARKS" if "OBS_REMARKS" in rows.columns else "REMARKS"
    order = [m.SRC, m.OBS_RID, *linker.order_columns(kind)]
    points = rows.select(
        *m.CHILD_COLUMNS[kind], "OBSID", remarks, "PROJECT", "x", "y", "z", *order
    )
    return correct_azimuths(points, declination)


def _usable(df: DataFrame, rules: Mapping[str, Rule]) -> dict[str, Column]:
    usable = {}
    for name, rule in rules.items():
        try:
            usable[name] = column_rule(df, name, rule)
        except Exception:
            log.exception("rule on column %s skipped; columns are %s", name, df.columns)
    return usable


def filter_invalid(
    df: DataFrame, rules: Mapping[str, Rule], metrics: Observation | None = None
) -> DataFrame:
    """Keep rows that pass every rule; a rule without its column is skipped.

    With ``metrics``, rows before the filter and after each rule in turn are
    counted inside the same job: ``rows_in``, then ``after_<column>``.
    """
    usable = _usable(df, rules)
    if metrics is not None:
        passed = F.lit(True)
        counts = [F.count(F.lit(1)).alias("rows_in")]
        for name, rule in usable.items():
            passed = passed & rule
            counts.append(F.count_if(passed).alias(f"after_{name}"))
        counts.append(F.count_if(passed).alias("rows_out"))
        df = df.observe(metrics, *counts)
    for rule in usable.values():
        df = df.where(rule)
    return df


def filter_valid(df: DataFrame, kind: str, metrics: Observation | None = None) -> DataFrame:
    """The validity filter of a dataset type; types without rules pass whole."""
    return filter_invalid(df, VALIDITY_RULES.get(kind, {}), metrics)


def validity_metrics(df: DataFrame, kind: str) -> DataFrame:
    """Rows before and after each rule of a type, as rows.

    ``kind, step, rule, rows_before, rows_after, rows_removed``; the last step
    ``total`` spans all rules.
    """
    usable = _usable(df, VALIDITY_RULES.get(kind, {}))
    passed, before = F.lit(True), F.count(F.lit(1))
    first, steps = before, []
    for step, (name, rule) in enumerate(usable.items(), start=1):
        passed = passed & rule
        after = F.count_if(passed)
        steps.append(_step(step, name, before, after))
        before = after
    steps.append(_step(len(usable) + 1, "total", first, before))
    counted = df.agg(F.array(*steps).alias("steps"))
    return counted.select(F.lit(kind).alias("kind"), F.inline("steps"))


def _step(step: int, rule: str, before: Column, after: Column) -> Column:
    return F.struct(
        F.lit(step).cast("long").alias("step"),
        F.lit(rule).alias("rule"),
        before.alias("rows_before"),
        after.alias("rows_after"),
        (before - after).alias("rows_removed"),
    )


def point_counts(df: DataFrame) -> DataFrame:
    """How many rows there are, and how many of them have no point."""
    missing = F.count_if(F.col("x").isNull() | F.col("y").isNull())
    return df.agg(F.count(F.lit(1)).alias("n"), missing.alias("n_missing"))


def with_row_index(df: DataFrame, order: list[str], to: str = "row_idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in a total order, without one task for all.

    A global sort range-partitions on the whole (unique) order key, so no
    source or observation can overload a task.  The sorted rows are written
    once to durable storage, which fixes partitions; each partition then adds
    the rows before it, one number per partition, to its own count.
    """
    spark = df.sparkSession
    stored = cut_lineage(df.orderBy(*order))
    tagged = stored.withColumn("_at", F.monotonically_increasing_id())
    counts = (
        tagged.select(F.shiftright("_at", 33).alias("_part")).groupBy("_part").count().collect()
    )
    offsets, total = [], 0
    for part, count in sorted((r[0], r[1]) for r in counts):
        offsets.append((part, total))
        total += count
    starts = spark.createDataFrame(offsets, "_part long, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_part", F.shiftright("_at", 33))
        # One row per partition of the sorted data.
        .join(F.broadcast(starts), "_part")
        .withColumn(to, F.col("_start") + within)
        .drop("_at", "_part", "_start")
    )


def empty_like(df: DataFrame) -> bool:
    """Whether a dataset has no rows; stops at the first one."""
    return df.isEmpty()
