"""Observations as nested records with six child lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators.linking import Linker, group_by_piece, piece_of, sorted_items


def _field(name: str) -> Callable[[Column], Column]:
    return lambda item: item[name]


def nested_observations(linker: Linker) -> DataFrame:
    """One record per observation: attributes, ``gdb_id`` and six arrays.

    The six child tables are stacked with one struct column each, so a single
    pair of aggregates builds all lists, instead of an aggregate and a join for
    every type.  Lists are sorted in pieces of bounded length and then
    concatenated; a type without rows gives an empty list.
    """
    parts = []
    for kind in m.ALL_TYPES:
        rows = linker.of_type(kind)
        order = linker.order_columns(kind)
        second = F.col(order[1]) if len(order) > 1 else F.lit(0)
        parts.append(
            rows.select(
                m.SRC,
                m.OBS_RID,
                F.lit(kind).alias("_kind"),
                piece_of(order).alias("_block"),
                F.col(m.RID).alias("k1"),
                second.cast("long").alias("k2"),
                F.struct(*m.CHILD_COLUMNS[kind]).alias(kind),
            )
        )
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    grouped = group_by_piece(stacked, [m.SRC, m.OBS_RID, "_kind"]).agg(
        sorted_items(["k1", "k2"], F.struct(*m.ALL_TYPES)).alias("items")
    )
    block = F.col("_g")["_block"].alias("block")
    pieces = grouped.select(
        F.col("_g")[m.SRC].alias(m.SRC),
        F.col("_g")[m.OBS_RID].alias(m.OBS_RID),
        *[
            F.when(
                F.col("_g")["_kind"] == kind,
                F.struct(block, F.transform("items", _field(kind)).alias("rows")),
            ).alias(kind)
            for kind in m.ALL_TYPES
        ],
    )
    lists = pieces.groupBy(m.SRC, m.OBS_RID).agg(
        *[
            F.flatten(
                F.transform(F.array_sort(F.collect_list(kind)), lambda p: p["rows"])
            ).alias(kind)
            for kind in m.ALL_TYPES
        ]
    )
    ids = linker.tectonic_ids().select(m.SRC, m.OBS_RID, F.col("GDB_ID").alias("gdb_id"))
    empty = {k: F.array().cast(lists.schema[k].dataType) for k in m.ALL_TYPES}
    return (
        linker.observations.join(lists, [m.SRC, m.OBS_RID], "left")
        .join(ids, [m.SRC, m.OBS_RID], "left")
        .withColumns(
            {
                "gdb_id": F.coalesce("gdb_id", F.lit("")),
                **{k: F.coalesce(k, empty[k]) for k in m.ALL_TYPES},
            }
        )
    )
