"""Databases of rows whose ids repeat or are missing."""

from __future__ import annotations

import io
import json
import sqlite3
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.registry import derived
from strataspark.sources import sqlite as source
from strataspark.sources.sqlite import load_model, mistyped_cells, read_table
from tests.helpers import make_model

OBS = [("a", 1, "O1", 60.0, 27.0, "x", "P"), ("a", 2, "O2", 61.0, 27.0, None, "P")]
SAMPLES = [("a", 7, "O1", "S1", "f"), ("a", 7, "O1", "S1", "f"), ("a", 7, "O2", "S2", "f"), ("a", None, "O2", "S3", "f")]
PLANARS = [("a", r, f"T{r}", "r", 1.0, 2.0, *["s"] * 5) for r in (4, 4, 5, None)]


@pytest.fixture
def written(spark, tmp_path):
    model = make_model(spark, observations=OBS, samples=SAMPLES, planars=PLANARS)
    folder = str(tmp_path / "databases")
    derived.write_files(derived.field_databases(model, "1", texts={m.PLANAR: ("DIP", 2)}), folder)
    return folder


def test_repeated_and_missing_row_ids_are_written_and_read(spark, written):
    model = load_model(spark, written)
    found = Counter(tuple(r)[1:] for r in model.samples.collect())
    assert found == Counter(r[1:] for r in SAMPLES)
    assert Counter(tuple(r)[1:] for r in model.observations.collect()) == Counter(r[1:] for r in OBS)
    assert sorted(r[m.RID] for r in mistyped_cells(spark, written, m.PLANAR).collect()) == [4, 4]
    assert read_table(spark, written, m.SAMPLE).where(f"{m.RID} = 7").count() == 3


def test_a_database_takes_its_rows_in_batches(spark, tmp_path):
    rows = [("a", i // 2, f"O{i}", f"S{i}", "f") for i in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        derived.write_files(
            derived.field_databases(make_model(spark, samples=rows), "1"), str(tmp_path / "db")
        )
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = read_table(spark, str(tmp_path / "db"), m.SAMPLE).select(m.RID, "SAMPLEID").collect()
    assert sorted(map(tuple, found)) == sorted((r[1], r[3]) for r in rows)


def test_ranges_of_repeated_row_ids_lose_no_row(tmp_path):
    path = tmp_path / "a.sqlite"
    connection = sqlite3.connect(path, isolation_level=None)
    connection.execute(f'CREATE TABLE "{m.SAMPLE}" ("OBSID")')
    derived.insert_rows(connection, m.SAMPLE, ["OBSID"], [(i // 3, "O") for i in range(90)])
    parts = source._split(str(path), m.SAMPLE, 4)
    assert len(parts) == 4
    counts = [
        connection.execute(f'SELECT count(*) FROM "{m.SAMPLE}" WHERE rowid BETWEEN {p.low} AND {p.high}').fetchone()[0]
        for p in parts
    ]
    assert sum(counts) == 90
    derived.insert_rows(connection, m.SAMPLE, ["OBSID"], [(None, "O")])
    assert [(p.low, p.high) for p in source._split(str(path), m.SAMPLE, 4)] == [(None, None)]
    connection.close()


def test_databases_are_no_cells_of_rows(spark, tmp_path):
    # A database grows on a task's disk and is copied in pieces, whatever its size.
    rows = [("a" if i % 3 else "b", i, f"O{i}", f"S{i}", "f") for i in range(90)]
    given = derived.field_databases(make_model(spark, samples=rows), "1")
    assert not [f for f in given.rows.schema if f.dataType.typeName() == "binary"]
    derived.write_files(given, str(tmp_path / "db"))
    assert sorted(p.name for p in (tmp_path / "db").glob("*")) == ["a@1.sqlite", "b@1.sqlite"]
    found = read_table(spark, str(tmp_path / "db"), m.SAMPLE).collect()
    assert sorted(map(tuple, found)) == sorted((f"{r[0]}@1.sqlite", *r[1:]) for r in rows)


def test_a_task_streams_a_database_to_its_file():
    columns = {m.SAMPLE: ["OBSID"]}
    told = {"snapshot": "1", "tables": columns, "texts": {}, "without": {}}
    options = {"path": "unused", **{k: json.dumps(v) for k, v in told.items()}}
    writer = derived.DatabasePerSource(options, False)
    names = ["source", "table", "rid", "row"]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(["a"] * 500), pa.array([m.SAMPLE] * 500), pa.array(range(at, at + 500)),
             pa.array([json.dumps({"OBSID": "O" * 4000})] * 500)],
            names=names,
        )
        for at in (0, 500)
    ]
    written = []

    class Stream(io.RawIOBase):
        def write(self, piece):
            written.append(len(piece))
            return len(piece)

    writer.write_files(iter(batches), lambda name: Stream())
    assert sum(written) > 4_000_000 and max(written) <= 1 << 20


def test_a_row_without_source_is_named(spark, tmp_path):
    given = derived.field_databases(make_model(spark, samples=[(None, 1, "O", "S", "f")]), "1")
    with pytest.raises(Exception, match="belongs to no database"):
        derived.write_files(given, str(tmp_path / "db"))


def test_cells_go_to_databases_in_columns_of_their_types(spark, tmp_path):
    # no row becomes a JSON text, and one run names databases by several snapshots.
    text = 'q"\\ ä\n\x00/,'
    observations = [("a", 1, text, 60.0, float("nan"), None, ""), ("b", None, None, None, float("inf"), text, "P")]
    planars = [("a", 3, "T", None, -0.0, 1e-310, *["s"] * 5), ("a", 3, None, "r", None, float("-inf"), *[None] * 5)]
    model = make_model(spark, observations=observations, planars=planars)
    given = derived.field_databases(model, F.when(F.col(m.SRC) == "a", F.lit("9")).otherwise(F.lit("2024-1")))
    assert "row" not in given.rows.columns
    derived.write_files(given, str(tmp_path / "db"))
    assert sorted(p.name for p in (tmp_path / "db").glob("*")) == ["a@9.sqlite", "b@2024-1.sqlite"]

    def cells(name, table):
        connection = sqlite3.connect(tmp_path / "db" / name)
        found = connection.execute(f'SELECT rowid, * FROM "{table}"').fetchall()
        connection.close()
        return sorted(tuple(row[-len(m.TABLE_COLUMNS[table]) :]) for row in found), sorted(row[0] for row in found)

    # As JSON has it, a number without a notation there is text.
    assert cells("a@9.sqlite", m.OBSERVATION) == ([(text, 60.0, "NaN", None, "")], [1])
    connection = sqlite3.connect(tmp_path / "db" / "b@2024-1.sqlite")
    assert connection.execute(f'SELECT rowid, LON, REMARKS FROM "{m.OBSERVATION}"').fetchall() == [(None, "Infinity", text)]
    connection.close()
    connection = sqlite3.connect(tmp_path / "db" / "a@9.sqlite")
    found = connection.execute(f'SELECT rowid, DIP, DIRECTION_OF_DIP, STYPE FROM "{m.PLANAR}" ORDER BY TM_GID').fetchall()
    connection.close()
    assert found == [(3, None, "-Infinity", None), (3, -0.0, 1e-310, "s")]


def test_cells_of_other_types_go_as_json(spark, tmp_path):
    model = make_model(spark, samples=[("a", 1, "O", "S", "f")])
    samples = model.samples.withColumn("FIELD_NAME", F.lit(True))
    given = derived.field_databases(m.FieldModel.from_tables(dict(model.items()) | {m.SAMPLE: samples}), "1")
    derived.write_files(given, str(tmp_path / "db"))
    connection = sqlite3.connect(tmp_path / "db" / "a@1.sqlite")
    assert connection.execute(f'SELECT rowid, * FROM "{m.SAMPLE}"').fetchall() == [(1, "O", "S", 1)]
    connection.close()


def test_text_is_decoded_by_sqlite_until_some_is_not_utf8(tmp_path, monkeypatch):
    # a call per cell only from the first batch on that needs one; no row is lost or read twice.
    monkeypatch.setattr(source, "BATCH_ROWS", 4)
    path = tmp_path / "a.sqlite"
    connection = sqlite3.connect(path, isolation_level=None)
    connection.execute(f'CREATE TABLE "{m.SAMPLE}" ("OBSID", "SAMPLEID", "FIELD_NAME")')
    rows = [(f"O{i}", i if i % 5 == 0 else f"S{i}", b"\xc3\xa4" if i % 7 == 0 else "f") for i in range(30)]
    connection.executemany(f'INSERT INTO "{m.SAMPLE}" VALUES (?, ?, ?)', rows)

    def read():
        opened, called = source._connect(str(path)), []
        own = opened.text_factory
        opened.text_factory = lambda raw: called.append(raw) or own(raw)
        batches = list(source.rows_of(opened, "a", m.SAMPLE, m.stored_schema(m.SAMPLE)))
        opened.close()
        return [tuple(r.values()) for b in batches for r in b.to_pylist()], called

    wanted = [("a", i + 1, f"O{i}", str(s) if i % 5 == 0 else s, "ä" if i % 7 == 0 else "f") for i, (_, s, _) in enumerate(rows)]
    found, called = read()
    # Column names are read the same way.
    assert found == wanted and not {b"f", b"O1", b"S1"} & set(called)
    connection.execute(f"""UPDATE "{m.SAMPLE}" SET FIELD_NAME = CAST(x'41ff' AS TEXT) WHERE rowid IN (13, 22)""")
    connection.close()
    for at in (12, 21):
        wanted[at] = (*wanted[at][:4], "A�")
    found, called = read()
    assert found == wanted and b"A\xff" in called and b"S1" not in called
