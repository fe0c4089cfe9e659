"""Filters of keys before a shuffle, spread inputs and commits of many files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark import session as sessions
from strataspark.operators import linking as link
from strataspark.operators import markers as mrk
from strataspark.operators.points import type_points
from strataspark.plans.export import gather_observations
from strataspark.registry import derived, queries
from strataspark.session import likely_in
from tests.helpers import make_model, rows
from tests.test_links import RULES

KEYS = 300


def test_a_filter_keeps_every_match_and_few_others(spark):
    keys = spark.range(0, 40000, 2).select(F.concat(F.lit("k"), "id").alias("key"))
    df = spark.range(40000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    kept = likely_in(df, ["k"], keys, 20000, ["key"])
    assert kept.columns == df.columns
    # One row per row of df, however often a key comes.
    assert likely_in(df, ["k"], keys.unionByName(keys), 20000, ["key"]).count() == kept.count()
    assert kept.where("id % 2 = 0").count() == 20000
    assert kept.where("id % 2 = 1").count() < 20000 / 5


def test_too_many_or_no_keys(spark):
    df = spark.range(10).select("id")
    assert likely_in(df, ["id"], df, sessions.FILTER_BITS) is df
    assert likely_in(df, ["id"], df.limit(0), 0).count() == 0
    nulls = spark.createDataFrame([(None,), (1,)], "id long")
    assert likely_in(nulls, ["id"], nulls, 2).count() == 2


@pytest.fixture(scope="module")
def model(spark):
    each = range(KEYS)
    name = [f"O{i // 2}" for i in each]
    return make_model(
        spark,
        observations=[("a", i, name[i], 60.0, 27.0, "r", "P " if i % 6 == 0 else "Q") for i in each],
        tectonics=[("a", i, name[i], f"T{i}") for i in each],
        planars=[("a", i, f"T{i % KEYS}", "r", float(i % 90), 2.0, *["s"] * 5) for i in range(2 * KEYS)],
        linears=[("a", i, f"T{i}", "r", 1.0, float(i % 90), "s", "t") for i in each],
        rocks=[("a", i, name[i], f"R{i}", "r", "f", "n") for i in each],
        textures=[("a", i, f"R{i}", "2", "1") for i in each],
        samples=[("a", i, name[i], f"S{i}", "f") for i in each],
        images=[("a", i, name[i], f"I{i}", "r") for i in each],
    )


@pytest.mark.parametrize("kind", m.ALL_TYPES)
def test_links_with_and_without_filter_agree(spark, model, kind):
    selected = gather_observations(model, RULES)
    given = [
        type_points(link.Linker(model, selected, RULES.exceptions, small, count=count), kind, 8.0)
        for small, count in ((True, None), (False, None), (False, 50))
    ]
    columns = given[0].columns
    plain, shuffled, filtered = (rows(df, *columns) for df in given)
    assert plain == shuffled == filtered and plain


def test_measured_linkers_filter_children_before_the_shuffle(spark, model, monkeypatch):
    monkeypatch.setattr(link, "BROADCAST_BYTES", 0)
    linker = link.Linker.over(model, gather_observations(model, RULES), RULES.exceptions)
    assert not linker.small and linker.count == 50
    plan = linker.samples()._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "_bits" in plan
    linker.release()


def test_links_on_the_same_keys_share_a_filter(spark, model, monkeypatch):
    monkeypatch.setattr(link, "BROADCAST_BYTES", 0)
    linker = link.Linker.over(model, gather_observations(model, RULES), RULES.exceptions)
    made = []
    monkeypatch.setattr(link, "filter_words", lambda *given: made.append(given) or sessions.filter_words(*given))
    for kind in (m.PLANARS, m.LINEARS, m.ROCKS, m.TEXTURES, m.IMAGES):
        assert linker.of_type(kind).count()
    # Of tectonic ids, observation ids and rock ids.
    assert len(made) == 3
    words = [w for w in linker._filters.values() if w is not None]
    assert words and all(w.is_cached for w in words)
    linker.release()
    assert not any(w.is_cached for w in words)


def test_kept_rows_take_few_partitions(spark):
    before = spark.conf.get(sessions._COALESCE_KEPT)
    sums = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))
    plain = sums.where("k < 50").persist()
    kept = sessions.kept(sums)
    assert rows(kept.where("k < 50"), "k", "n") == rows(plain, "k", "n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        other = sessions.kept(sums.withColumn("m", F.col("n") + 1))
        assert other.count() == 100 and other.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert spark.conf.get(sessions._COALESCE_KEPT) == before
    for df in (plain, kept, other):
        df.unpersist()


def test_inputs_of_one_row_group_are_spread(spark, tmp_path):
    spark.createDataFrame([(i, "A") for i in range(50)], "c_custkey long, c_mktsegment string").coalesce(
        1
    ).write.parquet(str(tmp_path / "customer.parquet"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (derived.rule_texts(spark, str(tmp_path)), derived.feature_lines(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == parts and df.count() == 50


def test_many_files_appear_under_their_names(spark, tmp_path):
    files = spark.range(300).select(
        F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")
    )
    derived.write_files(files, str(tmp_path / "out"))
    found = {p.name: p.read_text() for p in (tmp_path / "out").rglob("f*")}
    assert found == {f"f{i}": str(i) for i in range(300)}
    assert not (tmp_path / "out" / "_temporary").exists()


def test_links_for_popups_leave_out_what_observations_say(spark, model, monkeypatch):
    selected = mrk.first_per_id(gather_observations(model, RULES))
    files = model.images.select(F.concat("PICTURE_ID", F.lit(".jpg")).alias("path"))
    given = []
    for narrow in (True, False):
        linker = link.Linker(model, selected, RULES.exceptions, False, count=50)
        if not narrow:
            linker.__dict__["narrowed"] = linker
        else:
            kept = set(linker.narrowed.planars().columns)
            assert not kept & {"PROJECT", "OBS_REMARKS", "LAT", "x"}
        made = mrk.markers(linker, files)
        given.append(rows(made, *made.columns))
        linker.release()
    assert given[0] == given[1] and given[0]


def test_row_indexes_of_all_types_are_made_together(spark, monkeypatch):
    asked = []

    def together(session, jobs):
        asked.extend(jobs)
        return sessions.run_together(session, jobs)

    monkeypatch.setattr(queries, "run_together", together)
    assert queries.QUERIES["idx1_row_index"](spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(asked) == sorted(m.ALL_TYPES)
