"""Linking, order and nesting on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators import images as img
from strataspark.operators import linking as link
from strataspark.operators import markers as mrk
from strataspark.operators import merging, nested, points, selection, validation
from strataspark.plans import export, webmap
from strataspark.plans.rules import MapRules
from tests.helpers import make_model, rows

RULES = MapRules(projects=("P ",), declination=8.0, exceptions={"O3": "O1", "O4": None})


@pytest.fixture(scope="module")
def model(spark):
    return make_model(
        spark,
        observations=[
            ("a", 1, "O1", 60.0, 27.0, "first", "P "),
            ("a", 2, "O2", 61.0, 27.0, "second", "P "),
            ("a", 3, "O1", 62.0, 27.0, "again", "P "),
            ("a", 4, "O3", 63.0, 27.0, "mapped", "P "),
            ("a", 5, "O4", 64.0, 27.0, "nowhere", "P "),
            ("a", 6, "O5", 64.0, 27.0, "other project", "P"),
            ("a", 7, "O6", 64.0, 27.0, "no project", None),
            ("b", 1, "O1", 65.0, 27.0, "other source", "P "),
        ],
        tectonics=[
            ("a", 1, "O1", "T1"),
            ("a", 2, "O1", "T2"),
            ("a", 3, "O1", "T1"),
            ("a", 4, "O2", None),
            ("a", 5, "O4", "T4"),
            ("b", 1, "O1", "T1"),
        ],
        planars=[
            ("a", 1, "T2", "r", 45.0, 355.0, "s", "f", "t", "h", "ht"),
            ("a", 2, "T2", "r", 45.0, 355.0, "s", "f", "t", "h", "ht"),
            ("a", 3, "T2", None, 45.0, 355.0, "s", "f", "t", "h", "ht"),
            ("a", 4, "T1", "lost", 1.0, 1.0, "s", "f", "t", "h", "ht"),
            ("a", 5, "T2", "steep", 91.0, 10.0, "s", "f", "t", "h", "ht"),
            ("a", 6, None, "no key", 1.0, 1.0, "s", "f", "t", "h", "ht"),
            ("b", 1, "T1", "b", None, 10.0, "s", "f", "t", "h", "ht"),
        ],
        linears=[
            ("a", 1, "T2", "x", None, 10.0, "s", "t"),
            ("a", 2, "T2", "x", 77.0, 10.0, "s", "t"),
        ],
        rocks=[
            ("a", 1, "O1", "R1", None, "f", "n"),
            ("a", 2, "O1", "R2", None, "f", "n"),
            ("a", 3, "O1", "R3", None, "f", "n"),
            ("a", 4, "O1", "R4", None, "f", "n"),
        ],
        textures=[
            ("a", 1, "R1", "it's", "1"),
            ("a", 2, "R1", "it's", "1"),
            ("a", 3, "R2", None, "1"),
            ("a", 4, "R3", "z", "2"),
            ("a", 5, "R1", "b", "0"),
            ("a", 6, None, "lost", "0"),
        ],
        samples=[("a", 1, "O1", "S1", "f"), ("a", 2, "O3", "S3", "f")],
        images=[
            ("a", 1, "O1", "IMG1", "one"),
            ("a", 2, "O1", "IMG22", "two"),
            ("a", 3, "O1", "IMG3", "three"),
            ("a", 4, "O2", "IMG2", "many"),
            ("b", 1, "O1", "", "empty id"),
        ],
    )


@pytest.fixture(scope="module")
def linker(model):
    return export.link_observations(model, RULES)


def test_project_names_are_exact(spark, model):
    chosen = selection.in_projects(model.observations, ["P "])
    assert chosen.count() == 6
    assert selection.in_projects(model.observations, []).count() == 0


def test_last_appearing_id_wins_and_stays_in_its_source(linker):
    found = rows(linker.tectonic_ids(), m.SRC, m.OBS_RID, "GDB_ID", "n_ids")
    # T1 comes back after T2 and does not move; O3 is mapped to O1; O4 to nothing.
    assert found == [("a", 1, "T2", 2), ("a", 3, "T2", 2), ("a", 4, "T2", 2), ("b", 1, "T1", 1)]


def test_planars_are_distinct_per_observation(linker):
    found = rows(linker.planars(), m.SRC, m.OBS_RID, m.RID, "REMARKS")
    ours = [(1, "r"), (3, None), (5, "steep")]
    wanted = [("a", o, rid, text) for o in (1, 3, 4) for rid, text in ours] + [("b", 1, 1, "b")]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_remap_applies_to_samples_only_by_key(linker):
    assert rows(linker.samples(), m.OBS_RID, "SAMPLEID") == [(1, "S1"), (3, "S1"), (4, "S1")]
    assert {r[0] for r in rows(linker.images(), m.OBS_RID)} == {1, 2, 3}


def test_large_exception_maps_join_alike(spark, model):
    observations = export.gather_observations(model, RULES)
    many = {f"X{i}": "O9" for i in range(1000)} | dict(RULES.exceptions)
    by_join = link.remap_key(observations, "OBSID", many, "key")
    by_map = link.remap_key(observations, "OBSID", RULES.exceptions, "key")
    assert rows(by_join, m.OBS_RID, "key") == rows(by_map, m.OBS_RID, "key")


def test_tables_of_exceptions_and_rechecks_run_like_maps(spark, model):
    listed = spark.createDataFrame(list(RULES.exceptions.items()), "key string, value string")
    # A million more that name no observation; no row of theirs passes the driver.
    more = spark.range(1_000_000).selectExpr("concat('X', id) as key", "'O9' as value")
    again = spark.createDataFrame([("O2",), ("O2",), ("none",)], "key string")
    observations = export.gather_observations(model, RULES)
    by_map = link.Linker.over(model, observations, RULES.exceptions)
    by_table = link.Linker.over(model, observations, listed.union(more))
    for kind in m.ALL_TYPES:
        assert rows(by_table.of_type(kind)) == rows(by_map.of_type(kind))
    flagged = mrk.with_recheck(model.observations, again)
    assert flagged.count() == model.observations.count()
    assert [r[0] for r in rows(flagged.where("recheck"), "OBSID")] == ["O2"]
    by_map.release()
    by_table.release()


def test_texture_tuples(linker):
    found = rows(linker.rocks().where("_orid = 1"), m.RID, "ST_2")
    assert found == [(1, "(\"it's\", \"it's\", 'b')"), (2, "(None,)"), (3, "('z',)"), (4, None)]


def test_textures_keep_rock_order(linker):
    found = linker.textures().where("_orid = 1").orderBy(m.RID, "_rid2").select("ST_2", "ST_1")
    assert [tuple(r) for r in found.collect()] == [("it's", "1"), ("b", "0"), (None, "1"), ("z", "2")]


def test_pieces_of_long_lists_join_in_order(spark):
    n = 3 * link.PIECE + 5
    df = spark.range(n).select(
        F.lit("a").alias(m.SRC), F.lit("R").alias("ROP_GID"), F.col("id").alias(m.RID),
        F.col("id").cast("string").alias("ST_2"),
    )
    tuples = link.texture_tuples(df.repartition(7))
    assert tuples.count() == 1
    assert tuples.first()["ST_2"] == str(tuple(str(i) for i in range(n)))


def test_points_and_validity(linker):
    planars = points.type_points(linker, m.PLANARS, 8.0)
    assert "OBS_REMARKS" in planars.columns and "REMARKS" in planars.columns
    assert {r[0] for r in rows(planars, "DIRECTION_OF_DIP")} == {3.0, 18.0}
    assert points.filter_valid(planars, m.PLANARS).count() == 6
    steps = rows(points.validity_metrics(planars, m.PLANARS), "rule", "rows_before", "rows_after")
    assert steps == [("DIP", 10, 6), ("DIRECTION_OF_DIP", 6, 6), ("total", 10, 6)]
    samples = points.type_points(linker, m.SAMPLES, 8.0)
    assert "OBS_REMARKS" not in samples.columns
    assert {r[0] for r in rows(samples, "REMARKS")} == {"first", "again", "mapped"}


def test_rules_on_absent_or_text_columns(spark):
    df = spark.createDataFrame([(1, "45"), (2, "x")], "data long, DIP string")
    kept = points.filter_invalid(df.drop("DIP"), points.VALIDITY_RULES[m.PLANARS])
    assert kept.count() == 2
    assert points.filter_valid(df, m.PLANARS).count() == 0
    assert points.filter_valid(df, m.LINEARS).count() == 2


def test_row_index_is_gap_free_over_skewed_data(spark):
    hot = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("s"),
        F.col("id").alias("r"),
    )
    indexed = points.with_row_index(hot.repartition(9), ["s", "r"])
    found = [tuple(r) for r in indexed.orderBy("s", "r").select("row_idx").collect()]
    assert found == [(i,) for i in range(5000)]
    assert points.with_row_index(hot.where("r < 0"), ["s", "r"]).count() == 0


def test_missing_columns_are_all_named(spark):
    df = spark.createDataFrame([(1,)], "ST_2 long")
    with pytest.raises(ValueError, match="textures.ST_1, .*|images.PICTURE_ID.*textures.ST_1"):
        validation.require_columns({m.TEXTURES: df, m.IMAGES: df})
    with pytest.raises(ValueError, match="ABSENT"):
        points.subset(df, ["ABSENT"])
    assert points.subset(df, []).columns == ["ST_2"]


def test_contract(spark, model):
    with pytest.raises(validation.ContractError, match="PROJECT missing in a, row 7"):
        validation.enforce_contract(model)
    kept, found = validation.enforce_contract(model, "quarantine")
    assert found.count() == 1 and kept.observations.count() == 7
    assert validation.enforce_contract(kept)[1].count() == 0
    whole = spark.createDataFrame([(1, 2)], "LAT int, LON long")
    assert validation.widen_coordinates(whole).dtypes == [("LAT", "double"), ("LON", "double")]


def test_contract_of_a_run(spark, tmp_path):
    bad = make_model(
        spark,
        observations=[
            ("a", 1, "O1", None, 27.0, "r", "P"),
            ("a", 2, "O2", 60.0, 27.0, None, "other"),
        ],
        rocks=[("a", 1, "O1", None, "r", "f", "n"), ("a", 2, "O1", "R", "r", "f", "n")],
    )
    rules = MapRules(projects=("P",))
    with pytest.raises(validation.ContractError, match="Rock_observation_point.GDB_ID"):
        export.export_observations(bad, rules, str(tmp_path / "x"))
    report = export.export_observations(bad, rules, str(tmp_path / "y"), contract="quarantine")
    assert report[m.ROCKS] == {"rows_in": 1, "rows_out": 1}
    with pytest.raises(validation.ContractError, match="Observation.REMARKS"):
        export.export_observations(bad, rules, str(tmp_path / "z"), ["other"], [m.SAMPLES])
    with pytest.raises(ValueError, match="unknown contract"):
        export.export_observations(bad, rules, str(tmp_path / "z"), contract="maybe")


def test_web_map_run(spark, model, tmp_path):
    files = spark.createDataFrame([(f"/data/{f}",) for f in FILES], "path string")
    made = webmap.compile_webmap(spark, model, RULES, str(tmp_path), files=files, image_folder="/data/imgs")
    assert made.centre == (62.5, 27.0) and made.layers is None
    assert made.markers.count() == 4
    lines = spark.read.text(str(tmp_path / "markers.geojson"))
    assert lines.count() == 4 and all('"type":"Point"' in r["value"] for r in lines.collect())
    nobody = MapRules(projects=("nobody",))
    with pytest.raises(ValueError, match="centre"):
        webmap.compile_webmap(spark, model, nobody, str(tmp_path))


def test_models_need_all_columns(model):
    from dataclasses import replace

    broken = replace(model, planars=model.planars.drop("DIP", "H_SENCE"))
    with pytest.raises(ValueError, match="BFDS_Planar_structure.DIP, BFDS_Planar_structure.H_SENCE"):
        export.compile_types(broken, RULES)


def test_nan_becomes_null(spark):
    df = m.nan_to_null(spark.createDataFrame([(math.nan, "x"), (1.0, "y")], "DIP double, OBSID string"))
    assert [r[0] for r in df.collect()] == [None, 1.0]


def test_first_per_id_over_sources(linker):
    first = mrk.first_per_id(linker.observations)
    assert rows(first, "OBSID", m.SRC, m.OBS_RID) == [
        ("O1", "a", 1), ("O2", "a", 2), ("O3", "a", 4), ("O4", "a", 5)
    ]


def test_merge_refuses_repeated_ids(model):
    with pytest.raises(ValueError, match="O1"):
        merging.merge_models(model, model)


def test_merge_keeps_all_rows(spark):
    left = make_model(spark, observations=[("a", 1, "A", 1.0, 1.0, "r", "P")])
    right = make_model(spark, observations=[("b", 1, "B", 1.0, 1.0, "r", "P")], samples=[("b", 1, "B", "S", "f")])
    merged = merging.merge_models(left, right)
    assert merged.observations.count() == 2 and merged.samples.count() == 1


def test_centre(spark, model):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 3.0)], "LAT double, LON double")
    assert mrk.known_centre(df) == (2.0, 2.0)
    with pytest.raises(ValueError, match="centre"):
        mrk.known_centre(df.where("LAT > 9"))


FILES = ["imgs/IMG1.jpg", "imgs/IMG22.jpg", "imgs/xIMG3y.jpg", "imgs/IMG2b.jpg"]


def brute_force_matches(ids, paths):
    stems = {p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths}
    found = {}
    for i in ids:
        hits = [p for p in paths if i in stems[p]]
        if hits:
            found[i] = (len(hits), hits[0] if len(hits) == 1 else None)
    return found


@pytest.mark.parametrize("small", [True, False])
def test_file_matching_is_containment(spark, monkeypatch, small):
    import random

    dice = random.Random(5)
    paths = sorted({"d/" + "".join(dice.choices("abA", k=dice.randint(1, 7))) + ".jpg" for _ in range(150)})
    ids = sorted({"".join(dice.choices("abA", k=dice.randint(0, 4))) for _ in range(120)} | {"", "aaaaaaaaaaaa"})
    monkeypatch.setattr(img, "fits_broadcast", lambda df: small)
    found = img.match_files(
        spark.createDataFrame([(i,) for i in [*ids, *ids[:9]]], "PICTURE_ID string"),
        spark.createDataFrame([(p,) for p in [*paths, *paths[:9]]], "path string"),
    )
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == brute_force_matches(ids, paths)


def test_empty_id_matches_a_lone_file(spark):
    ids = spark.createDataFrame([("",)], "PICTURE_ID string")
    files = spark.createDataFrame([("d/a.jpg",)], "path string")
    assert [tuple(r) for r in img.match_files(ids, files).collect()] == [("", 1, "d/a.jpg")]


def test_markers(spark, model):
    files = spark.createDataFrame([(f"/data/{f}",) for f in FILES], "path string")
    found = webmap.compile_markers(model, MapRules(RULES.projects, rechecks=("O2",)), files, "/data/imgs")
    by_id = {r["OBSID"]: r for r in found.collect()}
    assert set(by_id) == {"O1", "O2", "O3", "O4"}
    first = by_id["O1"]
    # The first lineation counts, though its direction is unknown.
    assert (first["icon"], first["color"], first["angle"]) == ("glyphicon-arrow-up", "blue", None)
    assert (by_id["O2"]["icon"], by_id["O2"]["color"]) == ("glyphicon-stop", "red")
    assert by_id["O4"]["color"] == "lightgray"
    popup = first["popup"]
    heads = ["Planar Structures", "Linear Structures", "Rock Observations", "Samples", "Textures"]
    heads += ["Observation remarks", "Images"]
    assert [h for h in heads if f"<h4>{h}</h4>" in popup] == heads
    assert [popup.index(h) for h in heads] == sorted(popup.index(h) for h in heads)
    assert "steep" not in popup and "<td>91</td>" in popup
    assert popup.count("<img") == 2 and 'height=150 src="imgs/IMG1.jpg"' in popup
    assert '<a href="imgs/xIMG3y.jpg">IMG3: three</a>' in popup
    # IMG2 is part of two stems, so the whole block goes.
    assert by_id["O2"]["popup"].endswith("<h4>Images</h4>\n\n")
    assert by_id["O4"]["popup"] == "<h3>O4</h3>\n<h4>Observation remarks</h4>\n<p>nowhere</p>\n\n"


def test_many_rechecks_join_alike(spark, model):
    listed = [f"X{i}" for i in range(2000)] + ["O2"]
    flagged = mrk.with_recheck(model.observations, listed)
    assert [r[0] for r in rows(flagged.where("recheck"), "OBSID")] == ["O2"]


def test_nested_records(linker):
    by_key = {(r[m.SRC], r[m.OBS_RID]): r for r in nested.nested_observations(linker).collect()}
    assert len(by_key) == 6
    first = by_key[("a", 1)]
    assert first["gdb_id"] == "T2"
    assert [p["REMARKS"] for p in first["planars"]] == ["r", None, "steep"]
    assert [t["ST_2"] for t in first["textures"]] == ["it's", "b", None, "z"]
    assert [i["PICTURE_ID"] for i in first["images"]] == ["IMG1", "IMG22", "IMG3"]
    nowhere = by_key[("a", 5)]
    assert nowhere["gdb_id"] == "" and all(nowhere[k] == [] for k in m.ALL_TYPES)


def test_no_observation_exports_nothing_and_maps_nothing(model):
    nobody = MapRules(projects=("nobody",))
    with export.compiled_types(model, nobody) as compiled:
        assert compiled == {}
    with pytest.raises(ValueError, match="centre"):
        mrk.known_centre(export.gather_observations(model, nobody))


def test_reports_of_a_run(spark, model):
    linker = export.link_observations(model, RULES)
    assert rows(linker.ambiguous_observations(), "OBSID", m.SRC, "GDB_ID", "n_ids") == [
        ("O1", "a", "T2", 2), ("O1", "a", "T2", 2), ("O3", "a", "T2", 2)
    ]
    skipped = mrk.skipped_observations(export.gather_observations(model, RULES))
    assert rows(skipped, "OBSID", m.SRC, m.OBS_RID, "n") == [("O1", "a", 3, 3), ("O1", "b", 1, 3)]
    late = model.tectonics.union(spark.createDataFrame([("a", 9, "O1", None)], model.tectonics.schema))
    tables = dict(model.items()) | {m.TECTONIC: late}
    broken = m.FieldModel.from_tables(tables)
    with pytest.raises(ValueError, match="Tectonic_measurement.GDB_ID missing"):
        export.check_run(export.link_observations(broken, RULES))


def test_rocks_that_share_an_id_are_one_row_before_their_textures(spark):
    many = 60
    model = make_model(
        spark,
        observations=[("a", 1, "O", 62.0, 27.0, "r", "P ")],
        rocks=[("a", i, "O", f"R{i}", None, "f", "n") for i in range(many)],
        textures=[("a", i, "R0", "s2" if i % 2 else "x2", "s1") for i in range(many)],
    )
    rules = MapRules(("P ",), exceptions={f"R{i}": "R0" for i in range(1, many)})
    linker = export.link_observations(model, rules)
    found = linker.textures()
    assert sorted(r["ST_2"] for r in found.collect()) == ["s2", "x2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(_rid" in plan


def test_a_box_beyond_the_antimeridian_keeps_its_points(spark):
    at = spark.createDataFrame([("a", 1, 177.5, 63.0), ("a", 2, -179.0, 63.0), ("a", 3, 27.0, 63.0)],
                               f"{m.SRC} string, {m.RID} long, LON double, LAT double")
    box = (150000.0, 6900000.0, 350000.0, 7100000.0)
    assert {r[m.RID] for r in selection.within_bounds(at, box, 32601).collect()} >= {1}
