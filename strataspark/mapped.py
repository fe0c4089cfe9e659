"""The field-observation model as views over the TPC-H-like test tables.

Orders stand for observations and line items for everything measured there, so
all eight tables grow with the given data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.plans.rules import MapRules

# Which observations the rules name: every so many keys, from a first one up to a limit.
REMAPPED, RECHECKED = range(13, 500, 97), range(7, 700, 61)
REMAP_BY = 3

# The selection used by every registered query.
MAPPED_RULES = MapRules(
    projects=("1-URGENT", "2-HIGH"),
    bounds=(150000.0, 6700000.0, 500000.0, 7400000.0),
    bounds_epsg=3067,
    declination=8.0,
    exceptions={f"OB-{k}": f"OB-{k + REMAP_BY}" for k in REMAPPED},
    rechecks=tuple(f"OB-{k}" for k in RECHECKED),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(key: str) -> str:
    return f"concat('db', cast(floor({key} / 5) % 3 as string)) as {m.SRC}"


# Line number first, so that row ids follow it inside an order; the rest tells
# lines of one number apart.  Worked out of the row alone: no order, however
# many lines it has, is gathered anywhere.
_LINE_ID = (
    "(l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 104729"
    " + cast(round(l_extendedprice * 100) as bigint) * 31) % 1000000"
)


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a row id, a tectonic id and an observation id."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        _source("l_orderkey"),
        f"{_LINE_ID} as {m.RID}",
        "concat('TM-', l_orderkey, case when l_linenumber >= 6 then '-2' else '-1' end) as tmg",
        "concat('OB-', l_orderkey) as obk",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order; some ids occur twice, in or across sources."""
    return table(spark, sf_dir, "orders").selectExpr(
        _source("o_orderkey"),
        f"o_orderkey as {m.RID}",
        "concat('OB-', case when o_orderkey % 50 in (45, 49) then o_orderkey - 1 else o_orderkey end)"
        " as OBSID",
        "59.5d + (o_orderkey * 37 % 1000) / 100.0d as LAT",
        "20.0d + (o_custkey * 53 % 1200) / 100.0d as LON",
        "o_orderstatus as REMARKS",
        "o_orderpriority as PROJECT",
    )


def field_model(spark: SparkSession, sf_dir: str) -> m.FieldModel:
    """The eight tables."""
    lines = _line_items(spark, sf_dir)
    rid = m.RID
    planars = lines.where("l_linenumber in (1, 2, 6)").selectExpr(
        m.SRC,
        # Exact copies of some rows, as repeated syncs leave behind.
        f"explode(if({rid} % 17 = 0, array({rid}, {rid} + 500), array({rid}))) as {rid}",
        "tmg as TM_GID",
        "l_linestatus as REMARKS",
        "case when l_tax = 0.08d then null else l_quantity * 2 - 5 end as DIP",
        "cast(l_partkey * 7 % 400 as double) as DIRECTION_OF_DIP",
        "concat(l_returnflag, l_linestatus) as STYPE_TEXT",
        "l_linestatus as FOL_TYPE_TEXT",
        "l_returnflag as STYPE",
        "cast(l_linenumber % 3 as string) as H_SENCE",
        "concat('sense ', l_linenumber % 3) as H_SENCE_TEXT",
    )
    second = f"struct({rid} + 500 as rid, l_returnflag as ST_2, l_linestatus as ST_1)"
    first = f"struct({rid} as rid, l_linestatus as ST_2, l_returnflag as ST_1)"
    textures = (
        lines.where("l_linenumber = 1")
        .selectExpr(
            m.SRC,
            f"concat('RP-', {rid}) as ROP_GID",
            f"explode(if({rid} % 3 = 0, array({first}, {second}), array({first}))) as t",
        )
        .selectExpr(m.SRC, f"t.rid as {rid}", "ROP_GID", "t.ST_2", "t.ST_1")
    )
    return m.FieldModel(
        observations=observations(spark, sf_dir),
        tectonics=lines.where("l_linenumber <> 4").selectExpr(
            m.SRC, rid, "obk as OBSID", "tmg as GDB_ID"
        ),
        planars=planars,
        linears=lines.where("l_linenumber in (2, 3, 7)").selectExpr(
            m.SRC,
            rid,
            "tmg as TM_GID",
            "l_linestatus as REMARKS",
            "cast(l_partkey * 11 % 380 as double) as DIRECTION",
            "l_quantity * 2 - 8 as PLUNGE",
            "l_linestatus as STYPE_TEXT",
            "l_returnflag as STYPE",
        ),
        rocks=lines.where("l_linenumber <= 2").selectExpr(
            m.SRC,
            rid,
            "obk as OBSID",
            f"concat('RP-', {rid}) as GDB_ID",
            "case when l_tax = 0 then null else 'rock' end as REMARKS",
            "l_returnflag as FIELD_NAME",
            "l_linestatus as ROCK_NAME",
        ),
        textures=textures,
        samples=lines.where("l_discount >= 0.085d").selectExpr(
            m.SRC,
            rid,
            "obk as OBSID",
            f"concat('S-', {rid}) as SAMPLEID",
            "l_returnflag as FIELD_NAME",
        ),
        # Short ids are part of other ids, which makes some matches ambiguous.
        images=lines.where("l_tax < 0.015d").selectExpr(
            m.SRC,
            rid,
            "obk as OBSID",
            f"concat('IMG', case when {rid} % 13 = 0 then l_orderkey else {rid} end) as PICTURE_ID",
            "concat('pic ', l_linenumber) as REMARKS",
        ),
    )


def image_files(model: m.FieldModel) -> DataFrame:
    """A listing of image files with their sizes: ``path, width, height``."""
    rid = F.col(m.RID)
    extension = F.when(rid % 11 == 0, ".png").otherwise(".jpg")
    return model.images.where(rid % 7 != 0).select(
        F.concat(F.lit("imgs/"), F.col("PICTURE_ID"), extension).alias("path"),
        (400 + rid % 3000).alias("width"),
        (300 + rid % 2000).alias("height"),
    )


def styled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every second one links a stylesheet in its first line."""
    sheet = '<link rel="stylesheet" href="a.css"/>\n'
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(sheet), F.col("html")))
        .otherwise(F.col("html"))
        .alias("html"),
    )
