"""From source tables to exported point datasets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators.linking import Linker
from strataspark.operators.points import type_points
from strataspark.operators.selection import (
    in_projects,
    observation_keys,
    with_coordinates,
)
from strataspark.operators.validation import (
    RUN_REQUIREMENTS,
    complete_rows,
    raise_violations,
    violations,
)
from strataspark.plans.rules import MapRules
from strataspark.sinks.points import write_types
from strataspark.sources.sqlite import rejected_cells


def gather_observations(model: m.FieldModel, rules: MapRules) -> DataFrame:
    """The selected observations of all sources, with export coordinates."""
    return observation_keys(with_coordinates(model.observations, rules))


def link_observations(model: m.FieldModel, rules: MapRules) -> Linker:
    """A linker over the selected observations."""
    return Linker.over(model, gather_observations(model, rules), rules.exceptions)


def compile_types(
    model: m.FieldModel, rules: MapRules, types: Iterable[str] = m.ALL_TYPES
) -> dict[str, DataFrame]:
    """One point dataset per type, all lazy, before the validity filter."""
    linker = link_observations(model, rules)
    return {kind: type_points(linker, kind, rules.declination) for kind in types}


@contextmanager
def compiled_types(
    model: m.FieldModel,
    rules: MapRules,
    types: Iterable[str] = m.ALL_TYPES,
    check: bool = True,
) -> Iterator[dict[str, DataFrame]]:
    """As :func:`compile_types`, selecting observations once for all types.

    No selected observation gives an empty dict, as there is then nothing to
    compile.
    """
    with kept_linker(model, rules, gather_observations(model, rules)) as linker:
        if linker.observations.isEmpty():
            yield {}
        else:
            if check:
                check_run(linker)
                check_typed(linker, rules)
            yield {kind: type_points(linker, kind, rules.declination) for kind in types}


def check_run(linker: Linker, with_images: bool = False) -> None:
    """Raise when a row of this run lacks a value it cannot do without.

    An observation with several tectonic ids of which the last is NULL has none to take.
    """
    raise_violations(violations(linker.required_rows(with_images), RUN_REQUIREMENTS))
    raise_violations(unresolved(linker))


def check_typed(linker: Linker, rules: MapRules) -> None:
    """Raise when a numeric cell of this run holds text, as the scan of its database noted.

    Of observations, those of the run's projects count: one without coordinates lies in no box.
    """
    noted = {
        t: df.where(F.col(m.REJECTED).isNotNull())
        for t, df in linker.model.items()
        if m.REJECTED in df.columns
    }
    noted = {t: df for t, df in noted.items() if not df.isEmpty()}
    if m.OBSERVATION in noted:
        own = in_projects(noted[m.OBSERVATION], rules.projects)
        raise_violations(rejected_cells(own, m.OBSERVATION))
    ids = linker.tectonic_ids().select(m.SRC, F.col("GDB_ID").alias("TM_GID")).distinct()
    for table in (m.PLANAR, m.LINEAR):
        if table in noted:
            own = noted[table].join(ids, [m.SRC, "TM_GID"], "left_semi")
            raise_violations(rejected_cells(own, table))


def unresolved(linker: Linker) -> DataFrame:
    """Observations with several tectonic ids of which the one to take is NULL."""
    return linker.resolutions().where("GDB_ID is null and n_ids > 1").select(
        F.lit(m.TECTONIC).alias("table_name"),
        F.lit("GDB_ID").alias("column_name"),
        m.SRC,
        F.col(m.OBS_RID).alias(m.RID),
        F.lit("missing").alias("reason"),
    )


def check_observations(selected: DataFrame) -> None:
    """Raise when a selected observation lacks a value, whether or not a marker shows it."""
    own = selected.select(
        m.SRC, F.col(m.OBS_RID).alias(m.RID), "OBSID", F.col("OBS_REMARKS").alias("REMARKS"), "PROJECT"
    )
    raise_violations(violations({m.OBSERVATION: own}, RUN_REQUIREMENTS))


def complete_model(model: m.FieldModel) -> m.FieldModel:
    """The model without rows that would stop a run."""
    kept = {
        name: complete_rows(df, RUN_REQUIREMENTS.get(name, ())) for name, df in model.items()
    }
    for name, df in kept.items():
        if m.REJECTED in df.columns:
            kept[name] = df.where(F.col(m.REJECTED).isNull())
    return m.FieldModel.from_tables(kept)


@contextmanager
def kept_linker(model: m.FieldModel, rules: MapRules, selected: DataFrame) -> Iterator[Linker]:
    """A linker that lets go of what it keeps at the end of the block."""
    linker = Linker.over(model, selected, rules.exceptions)
    try:
        yield linker
    finally:
        linker.release()


def export_observations(
    model: m.FieldModel,
    rules: MapRules,
    folder: str,
    projects: Iterable[str] = (),
    types: Iterable[str] = m.ALL_TYPES,
    contract: str = "fail",
) -> dict[str, dict[str, int]]:
    """Compile and write all types; returns row counts of each type.

    A selected row without a value it must have, or with text in a numeric cell, stops the
    run, or is left out under ``contract="quarantine"``.
    """
    merged = rules.with_projects(list(projects))
    checked = under_contract(model, contract)
    with compiled_types(checked, merged, types, contract == "fail") as datasets:
        return write_types(datasets, folder)


def under_contract(model: m.FieldModel, contract: str) -> m.FieldModel:
    """The model as a run under ``contract`` sees it."""
    if contract not in ("fail", "quarantine"):
        raise ValueError(f"unknown contract {contract!r}")
    return model if contract == "fail" else complete_model(model)
