"""Inputs that Spark derives from the given tables for the registered queries."""

from __future__ import annotations

import json
import math
import os
import shutil
import sqlite3
import struct
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from strataspark import model as m
from strataspark import mapped
from strataspark.session import durable_folder
from strataspark.sinks.committed import CommittedFiles, CommittedWriter

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Row ids per staged database file.
FILE_ROWS = 10000
# Bytes of a database that are copied at a time.
_PIECE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own on the shared storage, on whatever file system that is."""
    return f"{durable_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def databases(df: DataFrame, table: str) -> DataFrame:
    """One table as SQLite databases ``path, content``, one per source and range of row ids.

    No database holds more than a range.
    """
    row_id, columns = m.RID, list(m.TABLE_COLUMNS[table])

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name, block = key
        connection = sqlite3.connect(":memory:")
        listed = ", ".join(f'"{c}"' for c in columns)
        connection.execute(f'CREATE TABLE "{table}" ({listed})')
        values = rows[[row_id, *columns]].astype(object)
        values = values.where(values.notna(), None)
        marks = ", ".join("?" * (len(columns) + 1))
        connection.executemany(
            f'INSERT INTO "{table}" (rowid, {listed}) VALUES ({marks})',
            values.itertuples(index=False, name=None),
        )
        connection.commit()
        content = connection.serialize()
        connection.close()
        return pd.DataFrame({"path": [f"given/{name}-{block}.sqlite"], "content": [content]})

    block = F.floor(F.col(m.RID) / FILE_ROWS).cast("long").alias("block")
    return df.groupBy(F.col(m.SRC).alias("name"), block).applyInPandas(
        write, "path string, content binary"
    )


# Order keys per field database.
BLOCK_KEYS = 10000


def with_block(df: DataFrame, table: str) -> DataFrame:
    """Rows named by source and range of order keys: links never leave such a part.

    Rows without an id belong to the first part.
    """
    key = F.col(m.RID) if table == m.OBSERVATION else F.floor(F.col(m.RID) / 10_000_000)
    block = F.coalesce(F.floor(key / BLOCK_KEYS).cast("long"), F.lit(0)).cast("string")
    return df.withColumn(m.SRC, F.concat(m.SRC, F.lit("-"), block))


@dataclass(frozen=True)
class FieldDatabases:
    """Databases to be written: their rows, and what :class:`FieldDatabaseFiles` is told of them."""

    rows: DataFrame
    options: dict[str, str]


def field_databases(
    model: m.FieldModel,
    snapshot: str | Column,
    texts: Mapping[str, tuple[str, int]] | None = None,
    without: Mapping[str, tuple[str, str | None]] | None = None,
) -> FieldDatabases:
    """All eight tables as databases for :func:`write_files`: one per source, named by its snapshot.

    Cells keep their types; ``_src`` says which database a row goes to, and ``snapshot``, which may
    follow from it, how that is named.  Row ids may repeat or be null, and a database may have any
    number of rows.  ``texts`` puts text into a column of a table, in every so many rows; ``without``
    leaves a column (None: the whole) of a table out of databases whose names begin so.
    """
    tables = dict(model.items())
    listed = {name: list(m.TABLE_COLUMNS[name]) for name in tables}
    kinds = {
        name: [df.schema[c].dataType.simpleString() for c in listed[name]] for name, df in tables.items()
    }
    plain = {kind for of in kinds.values() for kind in of} <= {"string", "double"}
    named = F.lit(snapshot) if isinstance(snapshot, str) else snapshot

    def cells(name: str) -> list[Column]:
        if not plain:
            return [F.to_json(F.struct(*listed[name]), {"ignoreNullFields": "false"}).alias("row")]
        return [
            F.array(*[c for c, k in zip(listed[name], kinds[name], strict=True) if k == kind])
            .cast(f"array<{kind}>")
            .alias(f"{kind}s")
            for kind in ("string", "double")
        ]

    rows = reduce(
        DataFrame.unionByName,
        [
            df.select(
                F.concat(F.col(m.SRC), F.lit("@"), named).alias("source"),
                # Numbers are in the order in which tables are listed.
                F.lit(number).alias("table"),
                F.col(m.RID).alias("rid"),
                *cells(name),
            )
            for number, (name, df) in enumerate(tables.items())
        ],
    )
    told = {
        "tables": listed,
        "kinds": kinds if plain else {},
        "texts": texts or {},
        "without": without or {},
    }
    return FieldDatabases(rows, {name: json.dumps(value) for name, value in told.items()})


class DatabasePerSource(CommittedWriter):
    """Rows ``source, table, rid`` and cells, in the order of sources and tables: each source is one database.

    Cells are lists ``strings`` and ``doubles`` (``kinds`` says which column is which), or a JSON text ``row``.
    A database grows on the task's own disk and goes to its folder in pieces, so that a task holds a
    batch of rows and SQLite's cache, however many rows a source has.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.listed, self.texts, self.without = (
            json.loads(options[name]) for name in ("tables", "texts", "without")
        )
        self.kinds = json.loads(options.get("kinds", "{}"))

    def write_files(self, batches: Iterator[pa.RecordBatch], open_file) -> None:
        with tempfile.TemporaryDirectory() as folder:
            for source, parts in groupby(_parts(batches), lambda part: part[0]):
                path = f"{folder}/database"
                self.write_database(path, source, (rows for _, rows in parts))
                with open(path, "rb") as given, open_file(f"{source}.sqlite") as stream:
                    shutil.copyfileobj(given, stream, _PIECE_BYTES)
                os.remove(path)

    def write_database(self, path: str, source: str, parts: Iterator[pa.RecordBatch]) -> None:
        connection = sqlite3.connect(path, isolation_level=None)
        # What a failed task leaves is thrown away.
        connection.execute("PRAGMA synchronous = OFF")
        connection.execute("PRAGMA journal_mode = MEMORY")
        connection.execute("PRAGMA locking_mode = EXCLUSIVE")
        stored: dict[str, list[str]] = {}
        for name, every in self.listed.items():
            begin, absent = self.without.get(name, ("\0", ""))
            here = source.startswith(begin)
            if here and absent is None:
                continue
            stored[name] = [c for c in every if not (here and c == absent)]
            connection.execute(f'CREATE TABLE "{name}" ({_quoted(stored[name])})')
        names = list(self.listed)
        for part in parts:
            for table, rows in _runs(part, "table"):
                name = names[table] if isinstance(table, int) else table
                if name in stored:
                    cells = self._cells(name, stored[name], rows)
                    insert_rows(connection, name, stored[name], list(zip(*cells, strict=True)))
        connection.close()

    def _cells(self, name: str, columns: list[str], rows: pa.RecordBatch) -> list[list]:
        """Row ids and cells of one table, each column as a list."""
        ids = rows.column("rid")
        ids = ids.to_pylist() if ids.null_count else ids.to_numpy().tolist()
        if self.kinds:
            kinds = self.kinds[name]
            lists = {k: _columns(rows.column(f"{k}s"), kinds.count(k)) for k in ("string", "double")}
            every = {c: next(lists[k]) for c, k in zip(self.listed[name], kinds, strict=True)}
            cells = [every[c] for c in columns]
        else:
            read = [json.loads(text) for text in rows.column("row").to_pylist()]
            cells = [[row[c] for row in read] for c in columns]
        spoiled, each = self.texts.get(name, ("", 1))
        if spoiled in columns:
            at = columns.index(spoiled)
            cells[at] = [
                "unread" if rid is not None and rid % each == 0 else value
                for rid, value in zip(ids, cells[at], strict=True)
            ]
        return [ids, *cells]


def _columns(lists: pa.ListArray, width: int) -> Iterator[list]:
    """The columns of rows that are lists of ``width`` texts or doubles, as SQLite takes them.

    Numbers that JSON has no word for become text, as in JSON.
    """
    flat = lists.flatten()
    if pa.types.is_floating(flat.type) and pc.all(pc.is_finite(flat)).as_py() is False:
        words = {math.inf: "Infinity", -math.inf: "-Infinity"}
        values = [words.get(v, v) if v is None or v == v else "NaN" for v in flat.to_pylist()]
    else:
        # A null number comes out as NaN, which SQLite takes for NULL.
        values = flat.to_numpy(zero_copy_only=False).tolist()
    return (values[at::width] for at in range(width))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The sources of batches that are in their order, each with its rows of a batch."""
    for batch in batches:
        for source, rows in _runs(batch, "source"):
            if source is None:
                raise ValueError("a row without a source belongs to no database")
            yield source, rows


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Rows of a batch that follow each other with the same value of a column."""
    runs = pc.run_end_encode(batch.column(column))
    start = 0
    for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield value, batch.slice(start, end - start)
        start = end


class FieldDatabaseFiles(DataSource):
    """Writes the rows of :func:`field_databases` as files."""

    @classmethod
    def name(cls) -> str:
        return "field_databases"

    def schema(self) -> StructType:
        return "source string, table int, rid long, strings array<string>, doubles array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> DatabasePerSource:
        return DatabasePerSource(self.options, overwrite)


def _quoted(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def insert_rows(
    connection: sqlite3.Connection, table: str, columns: list[str], rows: list[tuple]
) -> None:
    """Insert ``rows`` of a row id and cells; row ids may repeat or be None.

    SQLite's own row ids cannot, so from the first such row on the table keeps them in an indexed
    column of their name, which readers see in their place.  The connection commits by itself.
    """
    if not rows:
        return
    listed = _quoted(columns)
    own = any(r[1] == "rowid" for r in connection.execute(f'PRAGMA table_info("{table}")'))
    insert = f'INSERT INTO "{table}" (rowid, {listed}) VALUES ({", ".join("?" * (len(columns) + 1))})'
    connection.execute("SAVEPOINT rows")
    try:
        if not own and any(r[0] is None for r in rows):
            raise sqlite3.IntegrityError("a row without id")
        connection.executemany(insert, rows)
    except sqlite3.IntegrityError:
        if own:
            raise
        connection.execute("ROLLBACK TO rows")
        connection.execute(f'ALTER TABLE "{table}" RENAME TO "_given"')
        connection.execute(f'CREATE TABLE "{table}" (rowid INTEGER, {listed})')
        connection.execute(f'INSERT INTO "{table}" (rowid, {listed}) SELECT rowid, {listed} FROM "_given"')
        connection.execute('DROP TABLE "_given"')
        connection.execute(f'CREATE INDEX "{table}_rowid" ON "{table}" (rowid)')
        connection.executemany(insert, rows)
    connection.execute("RELEASE rows")


def write_files(files: DataFrame | FieldDatabases, folder: str) -> None:
    """Files ``name, content``, or databases, into a folder of the shared storage."""
    if isinstance(files, FieldDatabases):
        # Row ids in order are appended; a source's rows meet in one task, sorted on its disk.  Rows are
        # small where they are shuffled and much work where they are written, so partitions stay many.
        rows = spread(files.rows, "source").sortWithinPartitions("source", "table", "rid")
        kind, options = FieldDatabaseFiles, files.options
    else:
        rows, kind, options = files, CommittedFiles, {}
    rows.sparkSession.dataSource.register(kind)
    rows.write.format(kind.name()).options(**options).mode("append").save(folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Narrow rows that much work follows on, over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule file per customer: ``file, text``."""
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("# rules\n[exceptions]\nsite/"),
        key.cast("string"),
        F.lit(" = site/1\nsite/x\n\n[recheck]\n; listed\nsite/"),
        (key % 7).cast("string"),
        F.lit("\n[declination]\ndeclination_value: "),
        (key % 20).cast("string"),
        F.lit('.5\n\n[projects]\n"'),
        F.col("c_mktsegment"),
        F.lit("'s\n[bounds]\nepsg = 3067\nxmin = "),
        F.when(key % 5 == 0, "west").otherwise((key * 10).cast("string")),
        F.lit("\nxmax=900000\nymin= 6600000\nymax =7800000\n"),
    )
    customers = mapped.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return spread(customers).select(
        F.concat(F.lit("team"), key.cast("string"), F.lit(".ini")).alias("file"),
        text.alias("text"),
    )


def layer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON document per customer: a line and a point."""
    key = F.col("c_custkey")
    x, y = 200000 + key * 37 % 300000, 6700000 + key * 53 % 600000

    def at(dx: int, dy: int):
        return F.concat(
            F.lit("["), (x + dx).cast("string"), F.lit(".5,"), (y + dy).cast("string"), F.lit(".25]")
        )

    crs = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3067"}},'
    name = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('"}'))
    text = F.concat(
        F.lit('{"type":"FeatureCollection",' + crs + '"features":['),
        F.lit('{"type":"Feature","properties":'),
        name,
        F.lit(',"geometry":{"type":"LineString","coordinates":['),
        at(0, 0),
        F.lit(","),
        at(100, 50),
        F.lit(","),
        at(250, 75),
        F.lit(']}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":'),
        at(500, 500),
        F.lit("}}]}"),
    )
    return mapped.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("layers/"), F.col("c_custkey").cast("string"), F.lit(".geojson")).alias(
            "dataset"
        ),
        text.alias("text"),
    )


def feature_lines(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """One GeoJSON feature per customer and line, as ``value``.

    Lines begin with an id, a type, blanks or a record separator.  ``part`` adds a
    column that deals the lines out to three datasets.
    """
    key = F.col("c_custkey")
    x = (200000 + key * 37 % 300000).cast("string")
    y = (6700000 + key * 53 % 600000).cast("string")
    shape = F.when(
        key % 2 == 0, F.concat(F.lit('"Point","coordinates":['), x, F.lit(".5,"), y, F.lit("]"))
    ).otherwise(
        F.concat(
            F.lit('"LineString","coordinates":[['), x, F.lit(","), y, F.lit("],["),
            x, F.lit(".25,"), y, F.lit(".75]]"),
        )
    )
    begin = (
        F.when(key % 3 == 0, F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"type":"Feature",')))
        .when(key % 5 == 0, F.lit('\x1e{"type": "Feature" ,'))
        .otherwise(F.lit(' { "type":"Feature",'))
    )
    text = F.concat(
        begin,
        F.lit('"properties":{"key":'),
        key.cast("string"),
        F.lit('},"geometry":{"type":'),
        shape,
        F.when(key % 4 == 0, F.lit("}} ,")).otherwise(F.lit("}}")),
    )
    customers = mapped.table(spark, sf_dir, "customer").select("c_custkey")
    lines = spread(customers).select(text.alias("value"), (key % 3).alias("part"))
    return lines if part else lines.select("value")


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of two pixel rows, from the embeddings."""

    def pixel(value: Column) -> Column:
        grey = F.floor(F.abs(value.cast("double")) * 1000) % 256
        return F.lpad(F.hex(grey.cast("long")), 2, "0")

    pixels = F.array_join(F.transform("embedding", pixel), "")
    return mapped.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("imgs/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        F.floor(F.size("embedding") / 2).cast("int").alias("width"),
        F.lit(2).alias("height"),
        F.lit(1).alias("channels"),
        F.unhex(pixels).alias("data"),
    )


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def grey_png(width: int, height: int, pixels: bytes) -> bytes:
    """A grey image as an uncompressed PNG file."""
    lines = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + _chunk(b"IHDR", head)
        + _chunk(b"IDAT", zlib.compress(lines, 0))
        + _chunk(b"IEND", b"")
    )


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an image per embedding, of which every tenth file is none."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = [
                grey_png(r.width, r.height, r.data) if r.number % 10 != 3 else b"no image"
                for r in frame.itertuples()
            ]
            names = [f"v{n}.png" for n in frame["number"]]
            yield pd.DataFrame({"name": names, "content": contents})

    images = spread(small_images(spark, sf_dir)).select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("number"), "width", "height", "data"
    )
    folder = scratch(spark, "images")
    write_files(images.mapInPandas(encode, "name string, content binary"), folder)
    return folder
