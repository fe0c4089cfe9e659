"""Pushed filters, incremental ingest, rejects and committed files."""

import sqlite3

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark import session as sessions
from strataspark.functions.geo import curve_place
from strataspark.operators.validation import ContractError
from strataspark.plans import export
from strataspark.plans.ingest import clustered, ingest_folder
from strataspark.plans.rules import MapRules
from strataspark.sinks.committed import CommittedFiles
from strataspark.sources import sqlite
from strataspark.sources.shared import files_below
from strataspark.streaming import snapshots
from strataspark.streaming.tables import LandedTables
from tests.helpers import rows
from tests.test_sources import write_database

OBS = [
    ("O1", 60.5, 25.0, "r", "P1"), ("O2", 61.0, 25.0, "r", "P2"), (3, 62.0, 25.0, "r", "P1"),
    ("O4", "north", 25.0, "r", "P1"), (b"O5", 63.0, 25.0, "r", 7), ("O6", None, 25.0, "r", "p1"),
]
PLANARS = [
    ("T1", "r", 45, "358", "s", "f", 5, "h", "t"), ("T1", "r", "45", 10, "s", "f", 5, "h", "t"),
    ("T1", "r", 30, b"20", "s", "f", 5, "h", "t"), ("T2", "r", 5, "x", "s", "f", 5, "h", "t"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pushed")
    for source in ("one", "two"):
        write_database(root / f"{source}.sqlite", **{m.OBSERVATION: OBS, m.PLANAR: PLANARS})
    return str(root)


CASES = [
    (m.OBSERVATION, lambda: F.col("PROJECT") == "P1"),
    (m.OBSERVATION, lambda: F.col("PROJECT").isin("P2", "7")),
    (m.OBSERVATION, lambda: F.col("OBSID").isin("3", "O5")),
    (m.OBSERVATION, lambda: (F.col("LAT") > 60.9) & (F.col("LAT") <= 62.0)),
    (m.OBSERVATION, lambda: F.col("LAT") == 62),
    (m.OBSERVATION, lambda: F.col(m.RID).between(2, 4)),
    (m.OBSERVATION, lambda: F.col(m.SRC) == "two.sqlite"),
    (m.OBSERVATION, lambda: (F.col(m.SRC) == "none.sqlite") | (F.col("OBSID") == "O1")),
    (m.OBSERVATION, lambda: F.col(m.SRC).isin("one.sqlite", "x") & (F.col("PROJECT") != "P1")),
    (m.OBSERVATION, lambda: F.col("LAT").isNull()),
    (m.PLANAR, lambda: F.col("DIRECTION_OF_DIP") < 21),
    (m.PLANAR, lambda: F.col("DIRECTION_OF_DIP") > 300),
    (m.PLANAR, lambda: F.col("DIP") >= 30),
    (m.PLANAR, lambda: F.col("STYPE") == "5"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_pushed_filters_change_no_rows(spark, folder, case):
    table, condition = CASES[case][0], CASES[case][1]()
    read = sqlite.read_table(spark, folder, table)
    columns = [m.SRC, m.RID, *m.TABLE_COLUMNS[table]]
    stored = spark.createDataFrame(read.collect(), read.schema)
    assert rows(read.where(condition), *columns) == rows(stored.where(condition), *columns)


def test_filters_reach_the_databases(spark, folder):
    schema = m.table_schema(m.OBSERVATION)
    reader = sqlite.SqliteReader(schema, {"path": folder, "table": m.OBSERVATION})
    pushed = [
        sqlite.EqualTo((m.SRC,), "two.sqlite"),
        sqlite.EqualTo(("PROJECT",), "P1"),
        sqlite.GreaterThan((m.RID,), 1),
        sqlite.IsNotNull(("LAT",)),
    ]
    left = list(reader.pushFilters(pushed))
    assert left == pushed[1:]
    (partition,) = reader.partitions()
    assert [r.path.rpartition("/")[2] for r in partition.ranges] == ["two.sqlite"]
    # Rows 3 and 4 are of the project; row 5 holds a number there, which Spark compares.
    assert sum(b.num_rows for b in reader.read(partition)) == 3


def test_plan_shows_pushed_filters(spark, folder):
    read = sqlite.read_table(spark, folder, m.OBSERVATION).where("PROJECT = 'P1' and _src = 'one.sqlite'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    # What the source has settled is left out of Spark's filter.
    filters = [x for x in plan.splitlines() if x.lstrip(" +-:*()0123456789").startswith("Filter")]
    assert any("PROJECT" in line for line in filters)
    assert not any("_src" in line for line in filters)


def test_rejects_are_noted_in_one_pass(spark, folder):
    read = sqlite.read_table(spark, folder, m.PLANAR, rejects=True)
    assert rows(read.where(f"{m.SRC} = 'one.sqlite'"), m.RID, "DIP", m.REJECTED) == [
        (1, 45.0, None), (2, None, "DIP"), (3, 30.0, None), (4, 5.0, None)
    ]
    found = sqlite.mistyped_cells(spark, f"file://{folder}", m.OBSERVATION)
    assert rows(found, m.SRC, m.RID, "column_name") == [("one.sqlite", 4, "LAT"), ("two.sqlite", 4, "LAT")]


def test_rejects_of_databases_that_are_rows(spark, folder):
    files = spark.read.format("binaryFile").load(f"{folder}/*.sqlite")
    found = sqlite.rejected_cells(sqlite.parse_databases(files, m.PLANAR, rejects=True), m.PLANAR)
    assert rows(found, m.SRC, m.RID) == [("one.sqlite", 2), ("two.sqlite", 2)]


def test_text_in_numbers_stops_or_quarantines_a_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_database(
        tmp_path / "in" / "a.sqlite",
        **{
            m.OBSERVATION: [("O1", 62.8, 22.4, "r", "Q"), ("O2", "x", 22.4, "r", "other")],
            m.TECTONIC: [("O1", "T1")],
            m.PLANAR: [("T1", "r", "steep", 10, "s", "f", 5, "h", "t"), ("T1", "q", 45, 20, "s", "f", 5, "h", "t")],
        },
    )
    model = ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "lake"))
    rules = MapRules(("Q",))
    with pytest.raises(ContractError, match="DIP text in number"):
        export.export_observations(model, rules, str(tmp_path / "out"))
    report = export.export_observations(model, rules, str(tmp_path / "out"), contract="quarantine")
    assert report[m.PLANARS]["rows_out"] == 1
    with pytest.raises(ContractError, match="LAT text in number"):
        export.export_observations(model, MapRules(("other",)), str(tmp_path / "out"))


def test_tables_without_rejects_stay_readable(spark, tmp_path):
    planars = spark.createDataFrame([("a", 1)], f"{m.SRC} string, {m.RID} long")
    for table in m.FIELD_OF_TABLE:
        schema = m.table_schema(table)
        filled = planars.select(m.SRC, m.RID, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema[2:]])
        filled.write.parquet(str(tmp_path / table))
    model = m.FieldModel.from_parquet(spark, str(tmp_path))
    assert model.planars.where(F.col(m.REJECTED).isNotNull()).isEmpty()
    assert m.REJECTED not in model.samples.columns


def test_schema_violations_name_everything(spark, tmp_path):
    write_database(tmp_path / "whole.sqlite")
    connection = sqlite3.connect(tmp_path / "part.sqlite")
    for table, columns in m.TABLE_COLUMNS.items():
        if table != m.SAMPLE:
            connection.execute(f'CREATE TABLE "{table}" ({", ".join(columns[1:] if table == m.ROCK else columns)})')
    connection.close()
    found = sqlite.schema_violations(spark, str(tmp_path))
    wanted = [(m.ROCK, m.TABLE_COLUMNS[m.ROCK][0], "part.sqlite", "no column"), (m.SAMPLE, None, "part.sqlite", "no table")]
    assert rows(found, "table_name", "column_name", m.SRC, "reason") == sorted(wanted)
    assert sqlite.schema_violations(spark, str(tmp_path / "nowhere")).count() == 0


class Landing:
    def __init__(self, spark, path):
        self.spark, self.path, self.store = spark, path, LandedTables(spark, str(path / "tables"))
        (path / "landing").mkdir()

    def put(self, name, sample):
        write_database(
            self.path / "landing" / name,
            **{m.OBSERVATION: [("O1", 62.8, 22.4, "r", "Q")], m.SAMPLE: [("O1", sample, "f")]},
        )

    def watch(self):
        snapshots.watch_exports(
            self.spark, str(self.path / "landing"), str(self.path / "c"), str(self.path / "tables"),
            MapRules(("Q",)), str(self.path / "out"),
        ).awaitTermination()

    def files(self):
        return {str(f): f.stat().st_mtime_ns for f in (self.path / "tables").rglob("*.parquet")}

    def samples(self):
        return rows(self.store.model().samples, m.SRC, "SAMPLEID")


def test_only_changed_sources_are_read_and_written(spark, tmp_path):
    here = Landing(spark, tmp_path)
    here.put("team@9.sqlite", "old")
    here.put("still.sqlite", "own")
    here.watch()
    before = here.files()
    assert here.samples() == [("still", "own"), ("team", "old")]
    # A source that has not changed is not opened: its database may be gone.
    (tmp_path / "landing" / "still.sqlite").write_bytes(b"no database")
    here.put("team@10.sqlite", "new")
    here.put("team@8.sqlite", "stale")
    here.put("added@2024-1.sqlite", "first")
    here.watch()
    after = here.files()
    assert {f: after[f] for f in before} == before
    new = {f.rpartition("/")[0].rpartition("/")[2] for f in set(after) - set(before) if "manifest" not in f}
    assert new == {f"{m.SRC}=team", f"{m.SRC}=added"}
    assert here.samples() == [("added", "first"), ("still", "own"), ("team", "new")]
    found = spark.read.parquet(str(tmp_path / "out" / "samples.parquet"))
    assert rows(found, "SAMPLEID") == [("first",), ("new",), ("own",)]
    current = rows(here.store.current(), m.SRC, snapshots.SNAPSHOT, "landed")
    assert current == [("added", "2024-1", 1), ("still", "", 0), ("team", "10", 1)]


@pytest.mark.parametrize("listed", [10, 0])
def test_tables_leave_folders_that_do_not_count_unopened(spark, tmp_path, monkeypatch, listed):
    # which sources count is told by names as long as they are few, and then nothing is joined.
    from strataspark.streaming import tables

    monkeypatch.setattr(tables, "LISTED", listed)
    here = Landing(spark, tmp_path)
    landings = (("a@1", "b@1", "c@1", "d@1"), ("b@2", "c@2", "d@2"), ("d@3",), ("e@1", "f@1"), ("e@2", "f@2"))
    for n, names in enumerate(landings):
        for name in names:
            here.put(f"{name}.sqlite", name)
        here.store.land(snapshots.list_databases(spark, str(tmp_path / "landing")), n)
    wanted = [(n[0], n) for n in ("a@1", "b@2", "c@2", "d@3", "e@2", "f@2")]
    assert here.samples() == wanted
    model = here.store.model()
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for _, df in model.items()]
    assert all(("Join" in plan) == (listed == 0) for plan in plans)
    if listed:
        for n, name in ((0, "b"), (0, "d"), (1, "d"), (3, "e")):
            for file in (tmp_path / "tables" / m.SAMPLE / f"landed={n}" / f"{m.SRC}={name}").glob("*.parquet"):
                file.write_bytes(b"no table")
        assert rows(model.samples, m.SRC, "SAMPLEID") == wanted


def test_paths_with_a_scheme_are_not_looked_up(spark, tmp_path, monkeypatch):
    # listings give thousands of them, for each of the tables.
    write_database(tmp_path / "a.sqlite", **{m.SAMPLE: [("O1", "S", "f")]})
    asked = []
    real = sqlite.qualified
    monkeypatch.setattr(sqlite, "qualified", lambda s, path: asked.append(path) or real(s, path))
    path = str(tmp_path / "a.sqlite")
    for given in (f"file:{path}", f"file://{path}", path):
        assert rows(sqlite.read_files(spark, [given], m.SAMPLE), m.SRC, "SAMPLEID") == [("a.sqlite", "S")]
    assert asked == [path]


def test_folders_are_listed_by_few_tasks(spark):
    name = sessions._LISTING_TASKS
    before = spark.conf.get(name)
    with sessions.few_listing_tasks(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before


def test_repeated_batch_changes_nothing(spark, tmp_path):
    here = Landing(spark, tmp_path)
    here.put("team@1.sqlite", "x")
    files = snapshots.list_databases(spark, str(tmp_path / "landing"))
    assert here.store.land(files, 0) == 1
    before = here.files()
    assert here.store.land(files, 0) == 0 and here.store.land(files, 1) == 0
    assert here.files() == before and here.store.has_landed(0) and not here.store.has_landed(1)


def test_batch_that_failed_midway_is_invisible_and_written_anew(spark, tmp_path, monkeypatch):
    here = Landing(spark, tmp_path)
    here.put("team@1.sqlite", "x")
    here.store.land(snapshots.list_databases(spark, str(tmp_path / "landing")), 0)
    here.put("team@2.sqlite", "y")
    here.put("gone@1.sqlite", "z")
    files = snapshots.list_databases(spark, str(tmp_path / "landing"))
    from strataspark.streaming import tables

    real = tables.run_together
    monkeypatch.setattr(tables, "run_together", lambda s, jobs: real(s, dict(list(jobs.items())[:5])) and 1 / 0)
    with pytest.raises(ZeroDivisionError):
        here.store.land(files, 1)
    assert here.samples() == [("team", "x")]
    monkeypatch.undo()
    assert here.store.land(files.where(f"{m.SRC} != 'gone'"), 1) == 1
    assert here.samples() == [("team", "y")]


def test_superseded_batches_are_removed(spark, tmp_path):
    here = Landing(spark, tmp_path)
    for n, name in enumerate(("a@1", "b@1", "a@2")):
        here.put(f"{name}.sqlite", name)
        here.store.land(snapshots.list_databases(spark, str(tmp_path / "landing")), n)
    assert here.store.remove_superseded() == 1 and here.store.next_batch() == 3
    assert here.samples() == [("a", "a@2"), ("b", "b@1")]
    assert not (tmp_path / "tables" / m.SAMPLE / "landed=0").exists()
    assert here.store.remove_superseded() == 0


def test_export_without_a_stream(spark, tmp_path):
    here = Landing(spark, tmp_path)
    for name in ("a@1", "a@2"):
        here.put(f"{name}.sqlite", name)
        snapshots.export_newest(
            spark, str(tmp_path / "landing"), str(tmp_path / "tables"), MapRules(("Q",)), str(tmp_path / "out")
        )
        assert rows(spark.read.parquet(str(tmp_path / "out" / "samples.parquet")), "SAMPLEID") == [(name,)]


def test_long_runs_of_digits_are_ordered_as_numbers(spark):
    long = "1" * 45
    names = [("a", long + "1"), ("a", long + "0"), ("a", "9"), ("b", "007"), ("b", "7-1"), ("b", "08")]
    files = spark.createDataFrame(names, f"{m.SRC} string, {snapshots.SNAPSHOT} string")
    found = snapshots.newest_snapshots(files)
    assert rows(found, m.SRC, snapshots.SNAPSHOT) == [("a", long + "1"), ("b", "08")]


def committed(spark, df, folder, mode="append"):
    spark.dataSource.register(CommittedFiles)
    df.write.format(CommittedFiles.name()).mode(mode).save(folder)


def test_files_appear_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("a.bin", bytearray(b"1")), ("sub/b.bin", bytearray(b"22"))], "name string, content binary")
    committed(spark, df.repartition(2), f"file://{folder}")
    assert [(p[len(folder) + 1 :], n) for p, n in files_below(folder, ".bin")] == [("a.bin", 1), ("sub/b.bin", 2)]
    assert not (tmp_path / "out" / "_temporary").exists()
    committed(spark, df.limit(1), folder, "overwrite")
    assert [n for _, n in files_below(folder, ".bin")] == [1]
    assert files_below(str(tmp_path / "none"), ".bin") == []


def test_failed_job_leaves_no_file(spark, tmp_path):
    df = spark.range(0, 40, numPartitions=4).select(
        F.concat(F.lit("f"), "id").alias("name"),
        F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"),
    )
    with pytest.raises(Exception, match="broken"):
        committed(spark, df, str(tmp_path / "out"))
    assert files_below(str(tmp_path / "out"), "") == []


@pytest.mark.parametrize("names", [["a", "a"], ["../a", "b"], ["/a", "b"]])
def test_names_must_be_different_and_within(spark, tmp_path, names):
    df = spark.createDataFrame([(n, bytearray(b"1")) for n in names], "name string, content binary")
    with pytest.raises(Exception, match="two rows|no name"):
        committed(spark, df.repartition(2), str(tmp_path / "out"))
    assert files_below(str(tmp_path / "out"), "") == []


def test_curve_interleaves_the_cells_of_both_directions(spark):
    points = [(-90.0, -180.0), (90.0, 180.0), (60.5, 25.25), (-12.0, 179.99), (95.0, -200.0), (None, 1.0)]
    df = spark.createDataFrame(points, "LAT double, LON double")
    found = [r[0] for r in df.select(curve_place("LAT", "LON")).collect()]

    def cell(x, half):
        return int(min(max((x + half) * ((1 << 26) / (2 * half)), 0.0), (1 << 26) - 1))

    def place(lat, lon):
        a, b = cell(lat, 90.0), cell(lon, 180.0)
        return sum((a >> i & 1) << 2 * i + 1 | (b >> i & 1) << 2 * i for i in range(26))

    assert found == [None if lat is None else place(lat, lon) for lat, lon in points]


def _groups_read(folder, box):
    """Row groups whose statistics meet a box of latitudes and longitudes, and all row groups."""
    read = total = 0
    for path in folder.rglob("*.parquet"):
        groups = parquet.ParquetFile(path).metadata
        for i in range(groups.num_row_groups):
            bounds = []
            for c in range(groups.num_columns):
                column = groups.row_group(i).column(c)
                if column.path_in_schema in ("LAT", "LON"):
                    bounds.append((column.statistics.min, column.statistics.max))
            total += 1
            read += all(
                low <= b and high >= a for (low, high), (a, b) in zip(bounds, box, strict=True)
            )
    return read, total


def test_row_groups_of_a_box_fall_with_its_area(spark, tmp_path):
    points = spark.range(60_000).select(
        F.lit("s").alias(m.SRC), F.col("id").alias(m.RID), F.col("id").cast("string").alias("OBSID"),
        (60 + F.rand(1) * 8).alias("LAT"), (20 + F.rand(2) * 8).alias("LON"),
        F.lit("P").alias("PROJECT"), F.lit(None).cast("string").alias("REMARKS"),
    )
    boxes = {}
    for name, df in {
        "curve": clustered(points, m.OBSERVATION),
        "lines": points.repartitionByRange("PROJECT", "LAT").sortWithinPartitions("PROJECT", "LAT", "LON"),
    }.items():
        out = tmp_path / name
        df.write.option("parquet.block.size", 1 << 14).option(
            "parquet.page.size.row.check.min", 100
        ).option("parquet.block.size.row.check.min", 100).parquet(str(out))
        boxes[name] = [_groups_read(out, ((64, 64 + side), (24, 24 + side))) for side in (0.4, 1.6, 8)]
    (small, groups), (middle, _), _ = boxes["curve"]
    assert groups > 60
    # A 400th and a 25th of the area, and what their edges cut.
    assert small <= groups / 12 and middle <= groups / 5
    assert middle < boxes["lines"][1][0]
    # Rows are the same.
    both = [spark.read.parquet(str(tmp_path / n)).where("LAT < 64.4 and LON < 24.4") for n in boxes]
    assert rows(both[0]) == rows(both[1])
