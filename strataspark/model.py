"""The field-observation data model.

Eight tables, each the union over all source databases.  Two columns travel
with every row: ``_src`` (the database the row came from) and ``_rid`` (its row
id there).  Links between tables only hold inside one source, so ``_src`` is
part of every join key, and ``_rid`` is the only row order that exists.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields, replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Workers need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SRC = "_src"
RID = "_rid"
OBS_RID = "_orid"
# Names of a row's numeric columns whose cell is text or bytes and reads as NULL, comma-joined.
REJECTED = "_rejected"

# Table names of the field database format.
OBSERVATION = "Observation"
TECTONIC = "Tectonic_measurement"
PLANAR = "BFDS_Planar_structure"
LINEAR = "BFDS_Linear_structure"
ROCK = "Rock_observation_point"
TEXTURE = "BFDS_SaT"
SAMPLE = "Sample"
IMAGE = "Outcrop_picture"

# Column names of the field database format.
TABLE_COLUMNS: dict[str, tuple[str, ...]] = {
    OBSERVATION: ("OBSID", "LAT", "LON", "REMARKS", "PROJECT"),
    TECTONIC: ("OBSID", "GDB_ID"),
    PLANAR: (
        "TM_GID",
        "REMARKS",
        "DIP",
        "DIRECTION_OF_DIP",
        "STYPE_TEXT",
        "FOL_TYPE_TEXT",
        "STYPE",
        "H_SENCE",
        "H_SENCE_TEXT",
    ),
    LINEAR: ("TM_GID", "REMARKS", "DIRECTION", "PLUNGE", "STYPE_TEXT", "STYPE"),
    ROCK: ("OBSID", "GDB_ID", "REMARKS", "FIELD_NAME", "ROCK_NAME"),
    TEXTURE: ("ROP_GID", "ST_2", "ST_1"),
    SAMPLE: ("OBSID", "SAMPLEID", "FIELD_NAME"),
    IMAGE: ("OBSID", "PICTURE_ID", "REMARKS"),
}

NUMERIC_COLUMNS = frozenset({"LAT", "LON", "DIP", "DIRECTION_OF_DIP", "DIRECTION", "PLUNGE"})
AZIMUTH_COLUMNS = ("DIRECTION_OF_DIP", "DIRECTION")

# Names of the exported point datasets and their child columns.
PLANARS = "planars"
LINEARS = "linears"
ROCKS = "rock_observations"
IMAGES = "images"
SAMPLES = "samples"
TEXTURES = "textures"
ALL_TYPES = (PLANARS, LINEARS, ROCKS, IMAGES, SAMPLES, TEXTURES)

CHILD_COLUMNS: dict[str, tuple[str, ...]] = {
    PLANARS: TABLE_COLUMNS[PLANAR][1:],
    LINEARS: TABLE_COLUMNS[LINEAR][1:],
    ROCKS: ("REMARKS", "FIELD_NAME", "ROCK_NAME", "ST_2"),
    IMAGES: ("PICTURE_ID", "REMARKS"),
    SAMPLES: ("SAMPLEID", "FIELD_NAME"),
    TEXTURES: ("ST_2", "ST_1"),
}


def table_schema(table: str) -> StructType:
    """Explicit schema of one table, identity columns first."""
    named = [
        StructField(name, DoubleType() if name in NUMERIC_COLUMNS else StringType())
        for name in TABLE_COLUMNS[table]
    ]
    return StructType([StructField(SRC, StringType()), StructField(RID, LongType()), *named])


def stored_schema(table: str) -> StructType:
    """The schema of an ingested table: with what its scan rejected, where it has numbers."""
    schema = table_schema(table)
    if NUMERIC_COLUMNS.isdisjoint(schema.names):
        return schema
    return StructType([*schema, StructField(REJECTED, StringType())])


@dataclass(frozen=True)
class FieldModel:
    """The eight tables as DataFrames."""

    observations: DataFrame
    tectonics: DataFrame
    planars: DataFrame
    linears: DataFrame
    rocks: DataFrame
    textures: DataFrame
    samples: DataFrame
    images: DataFrame

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        """Pairs of physical table name and DataFrame."""
        for field in fields(self):
            yield TABLE_OF_FIELD[field.name], getattr(self, field.name)

    def with_observations(self, observations: DataFrame) -> FieldModel:
        """The same children under another observation table."""
        return replace(self, observations=observations)

    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> FieldModel:
        """Build from ``{physical table name: DataFrame}``."""
        missing = [name for name in FIELD_OF_TABLE if name not in tables]
        if missing:
            raise ValueError(f"missing tables: {', '.join(sorted(missing))}")
        return cls(**{FIELD_OF_TABLE[name]: tables[name] for name in FIELD_OF_TABLE})

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> FieldModel:
        """Read tables ingested by :func:`strataspark.plans.ingest.ingest_folder`.

        Schemas are explicit, so no file is opened to infer them.  Tables written without
        a column of rejects have rejected nothing.
        """
        return cls.from_tables(
            {
                name: spark.read.schema(stored_schema(name)).parquet(f"{folder}/{name}")
                for name in FIELD_OF_TABLE
            }
        )


TABLE_OF_FIELD = {
    "observations": OBSERVATION,
    "tectonics": TECTONIC,
    "planars": PLANAR,
    "linears": LINEAR,
    "rocks": ROCK,
    "textures": TEXTURE,
    "samples": SAMPLE,
    "images": IMAGE,
}
FIELD_OF_TABLE = {table: field for field, table in TABLE_OF_FIELD.items()}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in the numeric columns.

    Spark orders NaN above every number, so a NaN left in place would pass
    ``> 60`` while it fails every comparison in the data's own terms.
    """
    present = [c for c in df.columns if c in NUMERIC_COLUMNS]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in present})
