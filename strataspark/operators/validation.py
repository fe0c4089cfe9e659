"""Checks on schemas, on values that must be there, and on points."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from strataspark import model as m

# Columns a run cannot do without, by table.
REQUIRED_VALUES: dict[str, tuple[str, ...]] = {
    m.OBSERVATION: ("OBSID", "LAT", "LON", "REMARKS", "PROJECT"),
    m.IMAGE: ("PICTURE_ID", "REMARKS"),
    m.ROCK: ("GDB_ID",),
}

# What stops a run: an unknown place does not, it only has no point.
RUN_REQUIREMENTS: dict[str, tuple[str, ...]] = {
    m.OBSERVATION: ("OBSID", "REMARKS", "PROJECT"),
    m.ROCK: ("GDB_ID",),
    m.IMAGE: ("PICTURE_ID", "REMARKS"),
}


def missing_columns(
    frames: Mapping[str, DataFrame], required: Mapping[str, Iterable[str]] = m.CHILD_COLUMNS
) -> list[tuple[str, str]]:
    """Every ``(name, column)`` that is required and absent."""
    return [
        (name, column)
        for name, columns in required.items()
        if name in frames
        for column in columns
        if column not in frames[name].columns
    ]


def require_columns(
    frames: Mapping[str, DataFrame], required: Mapping[str, Iterable[str]] = m.CHILD_COLUMNS
) -> None:
    """Raise once, naming every missing column; types and NULLs are free."""
    absent = missing_columns(frames, required)
    if absent:
        raise ValueError("missing columns: " + ", ".join(f"{n}.{c}" for n, c in absent))


def require_tables(model: m.FieldModel) -> None:
    """Raise once, naming every column that a model's tables lack."""
    identity = (m.SRC, m.RID)
    require_columns(
        dict(model.items()), {t: (*identity, *c) for t, c in m.TABLE_COLUMNS.items()}
    )


def violations(
    tables: Mapping[str, DataFrame], required: Mapping[str, Iterable[str]] = REQUIRED_VALUES
) -> DataFrame:
    """Rows that break the value contract: ``table, column, _src, _rid, reason``.

    Each table is read once: a row's broken columns come out of one array.  The
    filter before it reaches the scan, where null counts rule out most files.
    """
    parts = []
    for table, columns in required.items():
        if table not in tables:
            continue
        broken_row = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        df = tables[table].where(broken_row)
        broken = F.filter(
            F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]),
            lambda c: c.isNotNull(),
        )
        parts.append(
            df.select(m.SRC, m.RID, F.explode(broken).alias("column_name")).select(
                F.lit(table).alias("table_name"),
                "column_name",
                m.SRC,
                m.RID,
                F.lit("missing").alias("reason"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


class ContractError(ValueError):
    """The data breaks the value contract."""


def raise_violations(found: DataFrame) -> None:
    """Raise on the first violation; stops looking once it has one."""
    first = found.first()
    if first is not None:
        where = f"{first['table_name']}.{first['column_name']}"
        raise ContractError(f"{where} {first['reason']} in {first[m.SRC]}, row {first[m.RID]}")


def enforce_contract(model: m.FieldModel, mode: str = "fail") -> tuple[m.FieldModel, DataFrame]:
    """Apply the value contract to all rows of a model.

    ``fail`` raises on the first violation.  ``quarantine`` returns the model
    without the violating rows, and the violations.
    """
    found = violations(dict(model.items()))
    if mode == "fail":
        raise_violations(found)
        return model, found
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    kept = {name: complete_rows(df, REQUIRED_VALUES.get(name, ())) for name, df in model.items()}
    return m.FieldModel.from_tables(kept), found


def complete_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    return df.dropna(subset=list(columns)) if columns else df


def widen_coordinates(observations: DataFrame) -> DataFrame:
    """Whole-number coordinates as doubles."""
    whole = [
        c
        for c in ("LAT", "LON")
        if isinstance(observations.schema[c].dataType, NumericType)
        and not isinstance(observations.schema[c].dataType, DoubleType)
    ]
    return observations.withColumns({c: F.col(c).cast("double") for c in whole})
