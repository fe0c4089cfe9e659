"""Hand-made models."""

from __future__ import annotations

from strataspark import model as m


def make_model(spark, **tables) -> m.FieldModel:
    """A model from rows by field name; rows are ``(_src, _rid, *columns)``."""
    frames = {}
    for field, table in m.TABLE_OF_FIELD.items():
        frames[table] = spark.createDataFrame(tables.get(field, []), m.table_schema(table))
    return m.FieldModel.from_tables(frames)


def rows(df, *columns) -> list[tuple]:
    """Sorted rows of the given columns."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
