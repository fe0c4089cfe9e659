"""Plans under skew: hot keys are split, and every strategy gives equal rows."""

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark import session as sessions
from strataspark.operators import linking as link
from strataspark.operators import markers as mrk
from strataspark.operators import nested
from strataspark.operators.points import type_points
from strataspark.plans.export import gather_observations
from strataspark.plans.rules import MapRules
from tests.helpers import make_model

RULES = MapRules(projects=("P",))
SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
}


@contextmanager
def settings(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_model(spark):
    """One observation holds a third of all children; one source half of them."""
    n, observations = 6000, 200
    empty = make_model(spark)
    ids = spark.range(n, numPartitions=12)
    which = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % observations)
    source = F.when(which < observations // 2, "big").otherwise("small")
    keyed = ids.select(source.alias(m.SRC), F.col("id").alias(m.RID), which.cast("string").alias("w"))
    obs_no = F.col("id")
    parents = spark.range(observations).select(
        F.when(obs_no < observations // 2, "big").otherwise("small").alias(m.SRC),
        obs_no.alias(m.RID),
        F.concat(F.lit("O"), obs_no.cast("string")).alias("OBSID"),
        (60.0 + obs_no / 100).alias("LAT"),
        F.lit(27.0).alias("LON"),
        F.lit("r").alias("REMARKS"),
        F.lit("P").alias("PROJECT"),
    )
    rid = F.col(m.RID).cast("string")
    obsid = F.concat(F.lit("O"), "w").alias("OBSID")
    padding = F.repeat(F.sha2(rid, 256), 2)
    return m.FieldModel.from_tables(
        {
            m.OBSERVATION: parents,
            m.TECTONIC: parents.select(m.SRC, m.RID, "OBSID", F.concat(F.lit("T"), "OBSID").alias("GDB_ID")),
            m.PLANAR: keyed.select(
                m.SRC, m.RID, F.concat(F.lit("TO"), "w").alias("TM_GID"), padding.alias("REMARKS"),
                (F.col(m.RID) % 90).cast("double").alias("DIP"), F.lit(10.0).alias("DIRECTION_OF_DIP"),
                *[F.lit("s").alias(c) for c in m.TABLE_COLUMNS[m.PLANAR][4:]],
            ),
            m.LINEAR: empty.linears,
            m.ROCK: keyed.select(
                m.SRC, m.RID, obsid, F.concat(F.lit("R"), rid).alias("GDB_ID"),
                *[F.lit("x").alias(c) for c in ("REMARKS", "FIELD_NAME", "ROCK_NAME")],
            ),
            m.TEXTURE: keyed.select(
                m.SRC, m.RID, F.concat(F.lit("R"), F.when(F.col("w") == "0", "0").otherwise(rid)).alias("ROP_GID"),
                rid.alias("ST_2"), F.lit("y").alias("ST_1"),
            ),
            m.SAMPLE: keyed.select(m.SRC, m.RID, obsid, rid.alias("SAMPLEID"), padding.alias("FIELD_NAME")),
            m.IMAGE: empty.images,
        }
    )


def linker(model, small):
    return link.Linker(model, gather_observations(model, RULES), {}, small)


def counted(df):
    return Counter(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("kind", [m.PLANARS, m.ROCKS, m.SAMPLES, m.TEXTURES])
def test_strategies_agree(spark, hot_model, kind):
    broadcast = counted(type_points(linker(hot_model, True), kind, 8.0))
    with settings(spark, SKEW):
        shuffled = counted(type_points(linker(hot_model, False), kind, 8.0))
    assert broadcast == shuffled and sum(broadcast.values()) > 0


def test_hot_observation_is_split_in_the_join(spark, hot_model):
    with settings(spark, SKEW):
        df = linker(hot_model, False).samples()
        assert df.count() == 6000
        found = df.groupBy(m.OBS_RID).count()
        found.collect()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_hot_tectonic_id_is_split_in_the_join(spark, hot_model):
    with settings(spark, SKEW):
        df = linker(hot_model, False).planars()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_selected_observations_filter_children_where_scanned(spark, hot_model):
    plan = linker(hot_model, True).samples()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_pieces_do_not_share_the_partitioning_of_a_join(spark, hot_model):
    with settings(spark, SKEW):
        rocks = linker(hot_model, False).rocks()
        plan = rocks._jdf.queryExecution().executedPlan().toString()
        lists = counted(rocks.where("_orid = 0").select("_rid", "ST_2"))
    assert "Exchange hashpartitioning(_g" in plan, [l for l in plan.splitlines() if "Exchange" in l]
    # The hot rock's tuple holds every texture row of the hot observation, in order.
    hot = next(k for k in lists if k[0].startswith("(") or k[1].startswith("("))
    assert str(tuple(str(i) for i in range(6000) if i % 3 == 0 or i % 200 == 0)) in hot


def test_nested_and_markers_under_skew(spark, hot_model):
    with settings(spark, SKEW):
        records = nested.nested_observations(linker(hot_model, False))
        sizes = {r[0]: r[1] for r in records.select(m.OBS_RID, F.size("samples")).collect()}
        shown = mrk.markers(linker(hot_model, False), None)
        assert shown.count() == 200
        popup = shown.where("OBSID = 'O0'").first()["popup"]
    assert len(sizes) == 200 and sizes[0] == 2020 and sum(sizes.values()) == 6000
    assert popup.count("<tr>") > 4000


def test_only_measured_sides_are_broadcast(spark):
    small = spark.range(10).select(F.col("id").cast("string").alias("s"))
    assert sessions.fits_broadcast(small)
    assert not sessions.fits_broadcast(small, limit_bytes=100)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert not sessions.fits_broadcast(wide, limit_bytes=1000)
    assert sessions.fits_broadcast(small.where("s = 'none'"), limit_bytes=0)


def test_durable_folder_is_the_sessions(spark):
    assert sessions.durable_folder(spark) == sessions.durable_folder(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
