"""Putting models and filtered tables together."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators.markers import duplicate_ids


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_models(left: m.FieldModel, right: m.FieldModel) -> m.FieldModel:
    """Both models as one; an observation id seen twice raises."""
    both = union_by_name([left.observations, right.observations])
    repeated = duplicate_ids(both).select("OBSID").limit(20).collect()
    if repeated:
        raise ValueError(f"observation ids are not unique, such as {[r[0] for r in repeated]}")
    theirs = dict(right.items())
    return m.FieldModel.from_tables(
        {name: union_by_name([df, theirs[name]]) for name, df in left.items()}
    )


def union_projects(*names: DataFrame) -> DataFrame:
    """The set union of project names."""
    return union_by_name([n.select("PROJECT") for n in names]).distinct()


def without_quotes(names: DataFrame) -> DataFrame:
    """Project names with both quote characters removed."""
    from strataspark.functions.text import strip_quotes

    return names.withColumn("PROJECT", strip_quotes(F.col("PROJECT")))
