"""Databases, rule files, layers and images read from folders."""

import math
import sqlite3
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.operators import images as img
from strataspark.operators import layers as lay
from strataspark.operators.points import filter_valid
from strataspark.plans import export, thumbnails, webmap
from strataspark.plans.ingest import ingest_folder
from strataspark.plans.rules import MapRules
from strataspark.sinks.points import CSV_OPTIONS, write_types
from strataspark.sources import config, images, layers, sqlite
from strataspark.streaming import snapshots
from tests.helpers import rows


def write_database(path, **tables):
    """A database with all tables; rows are tuples of the known columns."""
    connection = sqlite3.connect(path)
    for name, columns in m.TABLE_COLUMNS.items():
        # One column more than is used, and none with a declared type.
        connection.execute(f'CREATE TABLE "{name}" ({", ".join(columns)}, UNUSED)')
        for row in tables.get(name, []):
            marks = ", ".join("?" * len(columns))
            connection.execute(f'INSERT INTO "{name}" ({", ".join(columns)}) VALUES ({marks})', row)
    connection.commit()
    connection.close()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("databases")
    for source in ("one", "two"):
        write_database(
            root / f"{source}.sqlite",
            **{
                m.OBSERVATION: [
                    ("O1", 62.8, 22.4, f"{source} remark", "Q"),
                    ("O2", 62, 22.5, "whole degrees", "Q"),
                    ("O3", "far", math.nan, "bad cells", "R"),
                ],
                m.TECTONIC: [("O1", "T1")],
                m.PLANAR: [("T1", "r", 45.5, "358", "s", "f", 5, "h", b"ht")],
                m.SAMPLE: [("O2", "S1", None)],
            },
        )
    (root / "notes.txt").write_text("no database")
    (root / "deeper").mkdir()
    write_database(root / "deeper" / "three.sqlite")
    return str(root)


def test_scan_reads_every_database_of_the_folder(spark, folder):
    df = sqlite.read_table(spark, folder, m.OBSERVATION)
    assert df.schema == m.table_schema(m.OBSERVATION)
    found = rows(df, m.SRC, m.RID, "OBSID", "LAT", "LON")
    ours = [(1, "O1", 62.8, 22.4), (2, "O2", 62.0, 22.5), (3, "O3", None, None)]
    assert found == [(f"{s}.sqlite", *r) for s in ("one", "two") for r in ours]


def test_scan_converts_cells(spark, folder):
    row = sqlite.read_table(spark, folder, m.PLANAR).where("_src = 'one.sqlite'").first()
    assert (row["DIP"], row["DIRECTION_OF_DIP"]) == (45.5, 358.0)
    assert (row["STYPE"], row["H_SENCE_TEXT"]) == ("5", "ht")


def test_scan_of_chosen_columns(spark, folder):
    df = sqlite.read_table(spark, folder, m.PLANAR, ["DIP"])
    assert df.columns == [m.SRC, m.RID, "DIP"]
    assert df.count() == 2
    with pytest.raises(ValueError, match="NOPE"):
        sqlite.read_table(spark, folder, m.PLANAR, ["NOPE"])


def test_no_folder_gives_no_rows(spark, folder):
    for missing in ("/no/such/folder", f"{folder}/one.sqlite"):
        df = sqlite.read_table(spark, missing, m.OBSERVATION)
        assert df.count() == 0 and df.columns[:2] == [m.SRC, m.RID]


def test_missing_table_is_named(spark, tmp_path):
    sqlite3.connect(tmp_path / "bare.sqlite").execute("CREATE TABLE Sample (OBSID, SAMPLEID)")
    with pytest.raises(Exception, match="bare.sqlite has no table Observation"):
        sqlite.load_model(spark, str(tmp_path)).observations.collect()
    with pytest.raises(Exception, match="FIELD_NAME"):
        sqlite.read_table(spark, str(tmp_path), m.SAMPLE).collect()


def test_large_files_are_split(spark, tmp_path):
    many = [("O", f"S{i}", "f" * 50) for i in range(5000)]
    write_database(tmp_path / "big.sqlite", **{m.SAMPLE: many})
    write_database(tmp_path / "small.sqlite", **{m.SAMPLE: many[:10]})
    size = (tmp_path / "small.sqlite").stat().st_size
    tasks = sqlite.plan_ranges(sqlite.databases_of(str(tmp_path)), m.SAMPLE, size)
    assert len(tasks) > 5 and all(len(t) == 1 for t in tasks)
    df = (
        spark.read.format(sqlite.SHORT_NAME)
        .option("table", m.SAMPLE)
        .option("taskbytes", str(size))
        .load(str(tmp_path))
    )
    assert df.rdd.getNumPartitions() == len(tasks)
    assert df.count() == 5010
    assert df.where("_src = 'big.sqlite'").select(m.RID).distinct().count() == 5000


def test_small_files_share_a_task(tmp_path):
    for i in range(6):
        write_database(tmp_path / f"{i}.sqlite")
    size = (tmp_path / "0.sqlite").stat().st_size
    files = sqlite.databases_of(str(tmp_path))
    assert [len(t) for t in sqlite.plan_ranges(files, m.SAMPLE, 3 * size)] == [3, 3]


def test_tables_without_row_ids(spark, tmp_path):
    connection = sqlite3.connect(tmp_path / "w.sqlite")
    connection.execute("CREATE TABLE Sample (OBSID TEXT PRIMARY KEY, SAMPLEID, FIELD_NAME) WITHOUT ROWID")
    connection.executemany("INSERT INTO Sample VALUES (?, ?, ?)", [("a", "1", "f"), ("b", "2", "f")])
    connection.commit()
    assert rows(sqlite.read_table(spark, str(tmp_path), m.SAMPLE), m.RID, "OBSID") == [(1, "a"), (2, "b")]


def test_ingest_and_export(spark, folder, tmp_path):
    model = ingest_folder(spark, folder, str(tmp_path / "tables"))
    rules = MapRules(bounds=(50000.0, 6800000.0, 400000.0, 7100000.0), bounds_epsg=3067, declination=8.0)
    report = export.export_observations(model, rules, str(tmp_path / "out"), projects=["Q"])
    assert report[m.PLANARS] == {"rows_in": 2, "after_DIP": 2, "after_DIRECTION_OF_DIP": 2, "rows_out": 2}
    assert report[m.LINEARS] == {"rows_in": 0, "rows_out": 0}
    assert not (tmp_path / "out" / "linears.csv").exists()
    written = spark.read.parquet(str(tmp_path / "out" / "planars.parquet"))
    assert {r[0] for r in written.select("DIRECTION_OF_DIP").collect()} == {6.0}
    point = written.first()
    assert struct.unpack("<dd", bytes(point["geometry"])[5:]) == (point["x"], point["y"])
    csv = spark.read.option("header", True).csv(str(tmp_path / "out" / "samples.csv"))
    assert csv.columns[0] == "_c0" and sorted(r[0] for r in csv.collect()) == ["0", "1"]
    again = export.export_observations(model, MapRules(), str(tmp_path / "none"), ["nobody"])
    assert again == {} and not (tmp_path / "none").exists()


def test_index_keeps_gaps_of_the_filter(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1, i, float(dip), 10.0, 1.0, 2.0) for i, dip in enumerate([10, 95, 20])],
        f"{m.SRC} string, {m.OBS_RID} long, {m.RID} long, DIP double, DIRECTION_OF_DIP double, x double, y double",
    )
    write_types({m.PLANARS: df}, str(tmp_path), ["csv"])
    found = spark.read.option("header", True).csv(str(tmp_path / "planars.csv"))
    assert sorted(r[0] for r in found.collect()) == ["0", "2"]


def test_pushdown_on_ingested_tables(spark, folder, tmp_path):
    model = ingest_folder(spark, folder, str(tmp_path))
    rules = MapRules(("Q",), (50000.0, 6800000.0, 400000.0, 7100000.0), 3067)
    df = export.gather_observations(model, rules).select("OBSID")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(PROJECT,Q)" in pushed
    assert "GreaterThanOrEqual(LAT" in pushed and "LessThanOrEqual(LON" in pushed
    assert "REMARKS" not in plan.split("ReadSchema")[1]


def test_validity_reaches_the_scan(spark, folder, tmp_path):
    model = ingest_folder(spark, folder, str(tmp_path))
    planars = export.compile_types(model, MapRules(("Q",)), [m.PLANARS])[m.PLANARS]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = filter_valid(planars, m.PLANARS)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("GreaterThanOrEqual(DIP,0.0)" in line for line in plan.splitlines() if "PushedFilters" in line)


RULE_FILE = """# comment
[exceptions]
site/7 = site/70
site/x
[recheck]
Site 3
 ; indented comment
site 3
[declination]
declination_value	:	2.5
[projects]
"Test' Project "
a=b
[bounds]
epsg	=	3067
xmin = 310500
xmax = 420750
ymin =	7010000
ymax = 7155000
[empty]
"""


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.ini"
    path.write_text(RULE_FILE)
    rules = config.load_rules(spark, str(path))
    assert rules.exceptions == {"site/7": "site/70", "site/x": None}
    assert rules.rechecks == ("Site 3", "site 3")
    tables = config.load_rules(spark, str(path), as_tables=True)
    assert {tuple(r) for r in tables.exceptions.collect()} == set(rules.exceptions.items())
    assert {r["key"] for r in tables.rechecks.collect()} == set(rules.rechecks)
    assert (tables.projects, tables.bounds, tables.declination) == (rules.projects, rules.bounds, 2.5)
    assert rules.declination == 2.5
    assert rules.projects == ("Test Project ", "a")
    assert rules.bounds == (310500.0, 7010000.0, 420750.0, 7155000.0) and rules.bounds_epsg == 3067
    assert rules.with_projects(["a", "c"]).projects == ("Test Project ", "a", "c")
    lines = {(r["section"], r["key"]): r["line"] for r in config.read_rules(spark, str(path)).collect()}
    texts = RULE_FILE.split("\n")
    assert all(texts[n - 1].strip().startswith(k or f"[{s}]") for (s, k), n in lines.items())
    assert lines[("empty", None)] == 20


def test_rule_file_defaults_and_errors(spark, tmp_path):
    assert config.load_rules(spark, None) == MapRules()
    assert config.load_rules(spark, str(tmp_path / "none.ini")) == MapRules()

    def load(text):
        path = tmp_path / "r.ini"
        path.write_text(text)
        return config.load_rules(spark, str(path))

    assert load("") == MapRules()
    assert load("[declination]\ndeclination_value = 1.0\n").declination == 1.0
    partly = load("[bounds]\nepsg = 3067\nxmin = 1\nxmax = 2\nymin = here\nymax = 3\n")
    assert partly.bounds is None and partly.bounds_epsg is None
    with pytest.raises(KeyError):
        load("[declination]\nother = 1\n")
    with pytest.raises(ValueError, match="twice"):
        load("[recheck]\nA\nA\n")


LAYER = """{
"type": "FeatureCollection",
"crs": { "type": "name", "properties": { "name": "urn:ogc:def:crs:EPSG::3067" } },
"features": [
{ "type": "Feature", "properties": { "id": 1, "name": "fault" }, "geometry": { "type": "LineString", "coordinates": [ [ 500000.0, 6651411.190 ], [ 500100.0, 6651411.0, 5.0 ] ] } },
{ "type": "Feature", "properties": { }, "geometry": { "type": "Polygon", "coordinates": [ [ [ 1.0, 2.0 ], [ 3.0, 4.0 ], [ 1.0, 2.0 ] ] ] } },
{ "type": "Feature", "properties": null, "geometry": { "type": "MultiPolygon", "coordinates": [ [ [ [ 1, 2 ] ] ] ] } },
{ "type": "Feature", "properties": { }, "geometry": null }
]
}
"""


def test_geojson_documents_and_lines(spark, tmp_path):
    (tmp_path / "faults.geojson").write_text(LAYER)
    whole = layers.read_documents(spark, str(tmp_path))
    assert [r["epsg"] for r in whole.collect()] == [3067] * 4
    kinds = rows(whole, "geometry_type", F.size("vertices"))
    assert len(kinds) == 4 and (None, -1) not in kinds
    assert whole.where("feature_no = 0").first()["properties"] == {"id": "1", "name": "fault"}
    lines = layers.read_lines(spark, str(tmp_path), 3067)
    same = ["epsg", "geometry_type", F.to_json("vertices"), F.to_json("properties")]
    assert rows(lines, *same) == rows(whole, *same)


def test_layers_are_geographic_named_and_styled(spark, tmp_path):
    path = tmp_path / "faults.geojson"
    path.write_text(LAYER)
    features = layers.read_documents(spark, str(path))
    dataset = features.first()["dataset"]
    specs = lay.layer_specs(spark, [dataset], popup_fields=["name"], styles=["Lineament"], colors=["red"])
    styled = webmap.compile_layers(features, specs)
    first = styled.where("feature_no = 0").first()
    assert first["name"] == "faults" and first["popup"] == "fault"
    assert first["style"] == {"color": "red", "weight": "1"}
    lon, lat = first["vertices"][0][0][0]
    assert abs(lon - 27) < 1e-7 and abs(lat - 60) < 1e-7
    values = [r[0] for r in lay.geojson_lines(styled).collect()]
    parsed = spark.read.json(spark.sparkContext.parallelize(values))
    assert parsed.count() == 4 and "geometry" in parsed.columns


def test_layer_arguments(spark):
    specs = lay.layer_specs(spark, ["d/a.json", "d/b.json"], names=["A"], styles=[None, "Bedrock"])
    assert rows(specs, "position", "name", "style") == [(0, "A", None), (1, "b", "Bedrock")]
    assert lay.layer_specs(spark, []).count() == 0
    with pytest.raises(ValueError, match="more layer attributes"):
        lay.layer_specs(spark, ["a"], names=["A", "B"])
    with pytest.raises(ValueError, match="unknown styles"):
        lay.layer_specs(spark, ["a"], styles=["Fancy"])


def test_crs_names(spark):
    names = ["urn:ogc:def:crs:EPSG::3067", "EPSG:32635", "urn:ogc:def:crs:EPSG:6.9:4326", None,
             "urn:ogc:def:crs:OGC:1.3:CRS84", "local"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(lay.epsg_code(F.col("n"))).collect()] == [3067, 32635, 4326, 4326, 4326, None]


def write_png(path: Path, width: int, height: int, pixels: bytes) -> None:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + pixels[i * width : (i + 1) * width] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def test_image_listing(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.png", "d e.jpg"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.jpg").write_bytes(b"1")
    found = images.list_images(spark, str(tmp_path))
    assert sorted(Path(r["path"]).name for r in found.collect()) == ["a.jpg", "d e.jpg"]
    assert "content" not in found.columns


def test_thumbnails(spark, tmp_path):
    origin = tmp_path / "in"
    origin.mkdir()
    write_png(origin / "a.png", 4, 2, bytes(range(8)))
    write_png(origin / "done.png", 2, 2, bytes(range(4)))
    (origin / "broken.png").write_text("no image")
    done = spark.createDataFrame([("out/done.png",)], "path string")
    manifest = thumbnails.resize_images(spark, str(origin), str(tmp_path / "out"), done, 2, "png")
    assert rows(manifest, "name", "status", "new_width", "new_height") == [
        ("a.png", "resize", 2, 1), ("broken.png", "invalid", None, None), ("done.png", "exists", None, None)
    ]
    pixels = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["name"], r["width"], r["height"], bytes(r["data"])) for r in pixels] == [
        ("a.png", 2, 1, bytes([5, 7]))
    ]
    forced = thumbnails.resize_images(spark, str(origin), str(tmp_path / "all"), done, 2, "png", overwrite=True)
    assert forced.where("status = 'resize'").count() == 2


def test_nearest_indices():
    assert list(img.nearest_indices(4, 2)) == [1, 3]
    assert list(img.nearest_indices(2, 4)) == [0, 0, 1, 1]
    assert list(img.nearest_indices(3, 3)) == [0, 1, 2]


def test_stream_handles_each_new_snapshot_once(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "target", "checkpoint"))
    schema = f"{m.SRC} string, {snapshots.SNAPSHOT} string, v int"

    def land(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(landing)

    counts = []

    def watch():
        from pyspark.sql.types import StructType

        typed = StructType.fromDDL(schema)
        query = snapshots.watch_tables(
            spark, landing, typed, target, checkpoint, lambda batch, n: counts.append(batch.count())
        )
        query.awaitTermination()

    land([("a", "1", i) for i in range(10)])
    watch()
    watch()
    land([("a", "2", 99), ("b", "1", 7), ("b", "1", 8)])
    watch()
    assert counts == [10, 3]
    newest = snapshots.newest_snapshots(spark.read.schema(schema).parquet(f"{target}/batch=*"))
    assert rows(newest, m.SRC, "v") == [("a", 99), ("b", 7), ("b", 8)]


def test_stream_of_databases(spark, folder, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for name in ("team@2024-01.sqlite", "team@2024-02.sqlite", "other.sqlite"):
        write_database(landing / name, **{m.SAMPLE: [("O", name, "f")]})
    seen = []

    def pick_up(batch, number):
        files = snapshots.newest_snapshots(batch)
        paths = [r["path"] for r in files.collect()]
        seen.extend(rows(sqlite.read_files(batch.sparkSession, paths, m.SAMPLE), m.SRC, "SAMPLEID"))

    query = snapshots.watch_databases(spark, str(landing), str(tmp_path / "c"), pick_up)
    query.awaitTermination()
    assert seen == [("other.sqlite", "other.sqlite"), ("team@2024-02.sqlite", "team@2024-02.sqlite")]


def test_newest_snapshot_is_by_number(spark):
    named = [("a@9.sqlite", 1), ("a@10.sqlite", 2), ("b.sqlite", 3), ("c@2024-2.sqlite", 4), ("c@2024-10.sqlite", 5)]
    files = spark.createDataFrame([(f"/x/{n}", v) for n, v in named], "path string, v int")
    newest = snapshots.newest_snapshots(snapshots.with_snapshot(files))
    assert rows(newest, m.SRC, "v") == [("a", 2), ("b", 3), ("c", 5)]


def test_landed_databases_are_exported_again(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    out = str(tmp_path / "out")

    def land(name, sample):
        write_database(
            landing / name,
            **{m.OBSERVATION: [("O1", 62.8, 22.4, "r", "Q ")], m.SAMPLE: [("O1", sample, "f")]},
        )

    def watch():
        snapshots.watch_exports(
            spark, str(landing), str(tmp_path / "c"), str(tmp_path / "tables"), MapRules(("Q ",)), out
        ).awaitTermination()
        return rows(spark.read.parquet(f"{out}/samples.parquet"), "SAMPLEID", "PROJECT")

    land("team@9.sqlite", "old")
    assert watch() == [("old", "Q ")]
    land("team@10.sqlite", "new")
    land("other.sqlite", "own")
    assert watch() == [("new", "Q "), ("own", "Q ")]


def test_text_in_number_cells(spark, tmp_path):
    write_database(
        tmp_path / "t.sqlite",
        **{m.PLANAR: [("T1", "r", "45", "358", "s", "f", 5, "h", "ht"), ("T1", "r", 45, 358, "s", "f", 5, "h", "ht")]},
    )
    planars = sqlite.read_table(spark, str(tmp_path), m.PLANAR)
    assert rows(planars, m.RID, "DIP", "DIRECTION_OF_DIP") == [(1, None, 358.0), (2, 45.0, 358.0)]
    found = sqlite.mistyped_cells(spark, str(tmp_path), m.PLANAR)
    assert rows(found, "table_name", "column_name", m.RID, "reason") == [(m.PLANAR, "DIP", 1, "text in number")]
    assert sqlite.mistyped_cells(spark, "/no/such/folder", m.PLANAR).count() == 0


def test_lines_of_any_beginning(spark, tmp_path):
    point = '"geometry":{"type":"Point","coordinates":[1.5,2.5]}'
    lines = [
        '{"type":"Feature","properties":{"k":"a"},' + point + "}",
        '{"id":1,"type":"Feature","properties":{"k":"b"},' + point + "},",
        '\x1e{"type":"Feature","properties":{"k":"c"},' + point + "}",
        '  { "properties" : {"k":"d"}, ' + point + ', "type" : "Feature" } , ',
        '{"type":"Feature","crs":{"type":"name","properties":{"name":"EPSG:3067"}},"properties":{"k":"e"},' + point + "}",
        "",
    ]
    (tmp_path / "a b+c.txt").write_text("\n".join(lines))
    found = layers.read_lines(spark, str(tmp_path))
    assert rows(found, F.col("properties")["k"], "epsg") == [
        ("a", 4326), ("b", 4326), ("c", 4326), ("d", 4326), ("e", 3067)
    ]
    assert found.first()["dataset"].endswith("/a b+c.txt")
    (tmp_path / "cut.txt").write_text('{"type":"Feature",\n"properties":{}}')
    with pytest.raises(Exception, match="not on one line"):
        layers.read_lines(spark, str(tmp_path / "cut.txt")).collect()


def test_layers_from_paths_to_a_map(spark, tmp_path):
    (tmp_path / "my faults.geojson").write_text(LAYER)
    given = str(tmp_path / "my faults.geojson")
    styled = webmap.gather_layers(
        spark, [given, f"file:{given}"], names=["A"], popup_fields=["name"], styles=[None, "Own"],
        own_styles={"Own": {"color": "pink"}},
    )
    assert styled.groupBy("position", "name").count().count() == 2 and styled.count() == 8
    own = styled.where("position = 1").first()
    assert own["style"] == {"color": "pink"} and own["name"] == "my faults"
    features = layers.read_documents(spark, given)
    assert webmap.compile_layers(features, lay.layer_specs(spark, [given])).count() == 4
    (tmp_path / "none.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    with pytest.raises(ValueError, match="no features"):
        webmap.gather_layers(spark, [str(tmp_path / "none.geojson")])


def test_overwritten_thumbnails_spare_the_others(spark, tmp_path):
    for name, shade in (("a", 1), ("b", 2)):
        folder = tmp_path / name
        folder.mkdir()
        write_png(folder / f"{name}.png", 2, 2, bytes([shade] * 4))
    none = spark.createDataFrame([], "path string")
    out = str(tmp_path / "out")
    for name in ("a", "b"):
        thumbnails.resize_images(spark, str(tmp_path / name), out, none, 2, "png")
    write_png(tmp_path / "a" / "a.png", 2, 2, bytes([9] * 4))
    thumbnails.resize_images(spark, str(tmp_path / "a"), out, none, 2, "png", overwrite=True)
    found = thumbnails.stored_thumbnails(spark, out).collect()
    assert sorted((r["name"], bytes(r["data"])[0]) for r in found) == [("a.png", 9), ("b.png", 2)]


def test_rule_files_on_any_file_system(spark, tmp_path):
    path = tmp_path / "r.ini"
    path.write_text("[bounds]\nepsg\t=\t3067 \nxmin=1\nxmax =\t2\nymin=3\nymax=4\n")
    for given in (str(path), f"file:{path}", f"file://{path}"):
        assert config.load_rules(spark, given).bounds == (1.0, 3.0, 2.0, 4.0)
    assert config.load_rules(spark, f"file:{path}.none") == MapRules()
    (tmp_path / "other.ini").write_text("[declination]\ndeclination_value = 5\n")
    with pytest.raises(ValueError, match="several rule files"):
        config.load_rules(spark, str(tmp_path))


def test_sinks_keep_values(spark, tmp_path):
    values = [" lead", "tail ", 'a "quoted" one', "two\nlines", "", None, "plain, comma"]
    df = spark.createDataFrame(
        [("a", 1, i, v, "f", 1.0, 2.0) for i, v in enumerate(values)],
        f"{m.SRC} string, {m.OBS_RID} long, {m.RID} long, SAMPLEID string, FIELD_NAME string, x double, y double",
    )
    write_types({m.SAMPLES: df}, str(tmp_path), ["csv", "geojson"])
    read = spark.read.options(**CSV_OPTIONS, multiLine=True)
    found = read.csv(str(tmp_path / "samples.csv")).orderBy(F.col("_c0").cast("int")).collect()
    # The reader takes both kinds of nothing for null; the file tells them apart.
    assert [r["SAMPLEID"] for r in found] == [v or None for v in values]
    import csv

    cells = {}
    for part in (tmp_path / "samples.csv").glob("part-*"):
        with part.open(newline="") as file:
            cells |= {r[0]: r[1] for r in list(csv.reader(file))[1:]}
    assert cells == {str(i): v or "" for i, v in enumerate(values)}
    lines = spark.read.text(str(tmp_path / "samples.geojson")).collect()
    assert all('"SAMPLEID":' in r["value"] and "EPSG::3067" in r["value"] for r in lines)
    back = layers.read_lines(spark, str(tmp_path / "samples.geojson"))
    assert {r["epsg"] for r in back.collect()} == {3067}
    with pytest.raises(ValueError, match="no format"):
        write_types({m.SAMPLES: df}, str(tmp_path), [])


def test_databases_elsewhere_are_read_whole(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(folder)
    whole = sqlite.parse_databases(files, m.OBSERVATION)
    assert whole.schema == m.table_schema(m.OBSERVATION)
    columns = (m.SRC, m.RID, "OBSID", "LAT", "LON", "REMARKS")
    assert rows(whole, *columns) == rows(sqlite.read_table(spark, folder, m.OBSERVATION), *columns)
    named = sqlite.read_table(spark, f"file://{folder}", m.OBSERVATION)
    assert named.count() == whole.count() > 0
