"""Registered queries: ``(spark, sf_dir) -> DataFrame``, by operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark import mapped
from strataspark.functions import geo, rules, text
from strataspark.operators import images as img
from strataspark.operators import layers as lay
from strataspark.operators import linking as link
from strataspark.operators import markers as mrk
from strataspark.operators import merging, nested, points, selection, validation
from strataspark.plans import export, thumbnails, webmap
from strataspark.registry import derived
from strataspark.session import run_together
from strataspark.sinks import markers as marker_sink
from strataspark.sinks import points as point_sink
from strataspark.sources.config import parse_rules, rule_scalars
from strataspark.sources.images import list_images, read_images
from strataspark.sources.layers import parse_documents, read_lines
from strataspark.sources.sqlite import (
    load_model,
    mistyped_cells,
    parse_databases,
    read_table,
    schema_violations,
)
from strataspark.streaming import snapshots
from strataspark.streaming.tables import LandedTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RULES = mapped.MAPPED_RULES
UTM_EPSG = 32635


def query(function: Query) -> Query:
    """Register a function under its name."""
    QUERIES[function.__name__] = function
    return function


def _identity(df: DataFrame) -> list[Column]:
    names = {m.SRC: "src", m.OBS_RID: "orid", m.RID: "rid", "_rid2": "rid2"}
    return [F.col(c).alias(n) for c, n in names.items() if c in df.columns]


def _named(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Identity columns under plain names, then the given ones."""
    return df.select(*_identity(df), *columns)


def _metres(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in ("x", "y") if c in df.columns})


def _linker(spark: SparkSession, sf_dir: str) -> link.Linker:
    return export.link_observations(mapped.field_model(spark, sf_dir), RULES)


def _points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return export.compile_types(mapped.field_model(spark, sf_dir), RULES, [kind])[kind]


def _cells(df: DataFrame, table: str) -> DataFrame:
    """A table's rows with all cells as one text; numbers in thousandths."""
    shown = [
        F.round(F.col(c) * 1000).cast("long").cast("string") if c in m.NUMERIC_COLUMNS else F.col(c)
        for c in m.TABLE_COLUMNS[table]
    ]
    cells = F.concat_ws("|", *[F.coalesce(c, F.lit("NULL")) for c in shown])
    return _named(df, F.lit(table).alias("table_name"), cells.alias("cells"))


def _each_vertex(features: DataFrame, *columns: str) -> DataFrame:
    """The given columns with ``nth`` and ``v`` of every vertex of each feature."""
    flat = F.flatten(F.flatten("vertices"))
    return features.select(*columns, F.posexplode(flat).alias("nth", "v"))


def _dataset(df: DataFrame) -> DataFrame:
    """A point dataset with its identity, coordinates to the millimetre."""
    plain = [c for c in df.columns if not c.startswith("_")]
    return _metres(_named(df, *plain))


# --- filters ---------------------------------------------------------------


@query
def flt1_project_filter(spark, sf_dir):
    """FLT-1: observations of the given projects."""
    chosen = selection.in_projects(mapped.observations(spark, sf_dir), RULES.projects)
    return _named(chosen, "OBSID", "PROJECT")


@query
def flt1_project_table_filter(spark, sf_dir):
    """FLT-1 with the projects as a table: those with many orders."""
    observations = mapped.observations(spark, sf_dir)
    wanted = observations.where(F.col("REMARKS") == "P").select("PROJECT").distinct()
    return _named(selection.in_project_table(observations, wanted), "OBSID", "PROJECT")


@query
def flt2_bounds_filter(spark, sf_dir):
    """FLT-2: observations inside a projected box."""
    observations = mapped.observations(spark, sf_dir)
    inside = selection.within_bounds(observations, RULES.bounds, RULES.bounds_epsg)
    return _metres(_named(inside, "OBSID", "LAT", "LON", "x", "y"))


@query
def flt3_in_range(spark, sf_dir):
    """FLT-3: a dip in a range; NULL is out."""
    planars = mapped.field_model(spark, sf_dir).planars
    return _named(planars, "DIP", rules.in_range(F.col("DIP"), 10.0, 45.0).alias("inside"))


@query
def flt4_valid_readings(spark, sf_dir):
    """FLT-4: which planar readings are valid."""
    planars = mapped.field_model(spark, sf_dir).planars
    return _named(
        planars,
        rules.column_rule(planars, "DIP", rules.valid_dip).alias("dip_ok"),
        rules.column_rule(planars, "DIRECTION_OF_DIP", rules.valid_azimuth).alias("azimuth_ok"),
        rules.column_rule(planars, "STYPE_TEXT", rules.valid_dip).alias("text_ok"),
    )


@query
def flt5_valid_planars(spark, sf_dir):
    """FLT-5 and the whole chain before it: the flagship query."""
    return _dataset(points.filter_valid(_points(spark, sf_dir, m.PLANARS), m.PLANARS))


@query
def flt5_valid_linears(spark, sf_dir):
    """FLT-5 for linear structures."""
    return _dataset(points.filter_valid(_points(spark, sf_dir, m.LINEARS), m.LINEARS))


@query
def flt6_rule_filter(spark, sf_dir):
    """FLT-6: rules by column; one names a column that is not there."""
    planars = mapped.field_model(spark, sf_dir).planars
    kept = points.filter_invalid(
        planars,
        {"DIP": lambda c: c > 20.0, "ABSENT": rules.valid_dip, "DIRECTION_OF_DIP": rules.valid_azimuth},
    )
    return _named(kept, "DIP", "DIRECTION_OF_DIP")


@query
def flt7_empty_types(spark, sf_dir):
    """FLT-7: which selected datasets have no rows."""
    # Whether there are rows does not depend on what they say of their observations.
    linker = _linker(spark, sf_dir).narrowed
    parts = [
        linker.of_type(kind).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), (F.col("n") == 0).alias("is_empty")
        )
        for kind in m.ALL_TYPES
    ]
    return merging.union_by_name(parts)


# --- coordinates -----------------------------------------------------------


@query
def geo1_export_system(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3067."""
    return _metres(_named(geo.with_projected(mapped.observations(spark, sf_dir), 3067), "x", "y"))


@query
def geo1_utm_zone(spark, sf_dir):
    """GEO-1: EPSG:4326 to UTM zone 35 north, to the centimetre."""
    placed = geo.with_projected(mapped.observations(spark, sf_dir), UTM_EPSG)
    return _named(placed, F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query
def geo1_web_mercator(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3857."""
    return _metres(_named(geo.with_projected(mapped.observations(spark, sf_dir), 3857), "x", "y"))


def _placed_in(spark: SparkSession, sf_dir: str, epsg: int) -> DataFrame:
    """Observations in a system, to the centimetre."""
    placed = geo.with_projected(mapped.observations(spark, sf_dir), epsg)
    return _named(placed, F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query
def geo1_lambert_conic(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3034."""
    return _placed_in(spark, sf_dir, 3034)


@query
def geo1_equal_area(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3035."""
    return _placed_in(spark, sf_dir, 3035)


@query
def geo1_polar_stereographic(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3413."""
    return _placed_in(spark, sf_dir, 3413)


@query
def geo1_zone_of_one_degree(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:3879."""
    return _placed_in(spark, sf_dir, 3879)


@query
def geo1_shifted_datum(spark, sf_dir):
    """GEO-1: EPSG:4326 to EPSG:2393, whose datum is another one."""
    return _placed_in(spark, sf_dir, 2393)


@query
def geo2_layers_of_many_systems(spark, sf_dir):
    """GEO-2: features of four systems brought to EPSG:4326 in one pass."""
    key = F.col("c_custkey")
    codes = {0: 3034, 1: 3035, 2: 3413, 3: 3067}
    # Within the area of all four.
    corner = {3034: (4000000, 4000000), 3035: (4500000, 4500000), 3413: (1200000, -2000000), 3067: (300000, 6800000)}
    epsg, x, y = F.lit(None).cast("int"), F.lit(0.0), F.lit(0.0)
    for rest, code in codes.items():
        here = key % len(codes) == rest
        epsg = F.when(here, code).otherwise(epsg)
        x = F.when(here, corner[code][0] + key * 37 % 200000 + 0.25).otherwise(x)
        y = F.when(here, corner[code][1] + key * 53 % 200000 + 0.5).otherwise(y)
    features = mapped.table(spark, sf_dir, "customer").select(
        key.cast("long").alias("key"), epsg.alias("epsg"), epsg.alias("code"),
        F.array(F.array(F.array(F.array(x, y)))).alias("vertices"),
    )
    moved = lay.to_geographic(features, codes.values())
    return _each_vertex(moved, "key", "code").select(
        "key", "code", F.round(F.col("v")[0], 8).alias("lon"), F.round(F.col("v")[1], 8).alias("lat")
    )


@query
def flt2_bounds_in_other_systems(spark, sf_dir):
    """FLT-2: boxes of five systems, each with its envelope before it."""
    observations = mapped.observations(spark, sf_dir)
    boxes = {
        3034: (4450000.0, 3700000.0, 4700000.0, 4100000.0),
        3035: (4800000.0, 4150000.0, 5100000.0, 4500000.0),
        3413: (2000000.0, -1200000.0, 2600000.0, -500000.0),
        3879: (25350000.0, 6650000.0, 25600000.0, 7000000.0),
        2393: (3300000.0, 6700000.0, 3500000.0, 7100000.0),
    }
    found = None
    for epsg, box in boxes.items():
        inside = selection.within_bounds(observations, box, epsg)
        rows = _named(inside, F.lit(epsg).alias("epsg"), "OBSID")
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def geo2_unproject(spark, sf_dir):
    """GEO-2: layer vertices from EPSG:3067 to EPSG:4326."""
    features = lay.to_geographic(parse_documents(derived.layer_documents(spark, sf_dir)), [3067])
    return _each_vertex(features, "dataset", "feature_no").select(
        "dataset",
        "feature_no",
        F.col("nth").cast("long").alias("nth"),
        F.round(F.col("v")[0], 9).alias("lon"),
        F.round(F.col("v")[1], 9).alias("lat"),
    )


@query
def geo3_point_wkb(spark, sf_dir):
    """GEO-3: WKB points, shown as the bits of their coordinates."""
    observations = mapped.observations(spark, sf_dir)
    wkb = F.hex(geo.point_wkb(F.col("LON"), F.col("LAT")))

    def bits(first: int) -> Column:
        pairs = [F.substring("wkb", first + 2 * i, 2) for i in reversed(range(8))]
        return F.lpad(F.conv(F.concat(*pairs), 16, 2), 64, "0")

    tagged = observations.withColumn("wkb", wkb)
    return _named(
        tagged,
        F.substring("wkb", 1, 10).alias("head"),
        bits(11).alias("lon_bits"),
        bits(27).alias("lat_bits"),
    )


@query
def geo4_point_in_box(spark, sf_dir):
    """GEO-4: the inclusive test itself, in degrees, with edges hit."""
    inside = geo.in_box(F.col("LON"), F.col("LAT"), (30.0, 65.0, 22.0, 60.0))
    return _named(mapped.observations(spark, sf_dir), "LAT", "LON", inside.alias("inside"))


@query
def prj3_coordinates(spark, sf_dir):
    """PRJ-3: x, y and the constant z of selected observations."""
    chosen = selection.with_coordinates(mapped.observations(spark, sf_dir), RULES)
    return _metres(_named(chosen, "OBSID", "x", "y", "z"))


# --- projections -----------------------------------------------------------


@query
def prj1_column_subset(spark, sf_dir):
    """PRJ-1: named columns after a presence check."""
    planars = mapped.field_model(spark, sf_dir).planars
    return _named(points.subset(planars, [m.SRC, m.RID, "DIP", "STYPE"]), "DIP", "STYPE")


@query
def prj2_images_keep_both_remarks(spark, sf_dir):
    """PRJ-2: a child with remarks of its own."""
    rows = points.with_observation_remarks(_linker(spark, sf_dir).images())
    return _named(rows, "OBSID", "PROJECT", "REMARKS", "OBS_REMARKS")


@query
def prj2_samples_take_remarks(spark, sf_dir):
    """PRJ-2: a child without remarks takes the observation's."""
    rows = points.with_observation_remarks(_linker(spark, sf_dir).samples())
    return _named(rows, "OBSID", "PROJECT", "SAMPLEID", "REMARKS")


@query
def prj4_popup_columns(spark, sf_dir):
    """PRJ-4: popup tables without the child's remarks and keys."""
    return _named(_linker(spark, sf_dir).rocks(), *mrk.popup_columns(m.ROCKS))


@query
def idx1_row_index(spark, sf_dir):
    """IDX-1: a gap-free ordinal before the filter, gaps after it, for all types."""
    compiled = export.compile_types(mapped.field_model(spark, sf_dir), RULES)

    def indexed(kind: str) -> DataFrame:
        order = [m.SRC, m.OBS_RID, *link.Linker.order_columns(kind)]
        rows = points.filter_valid(points.with_row_index(compiled[kind], order), kind)
        return _named(rows, "row_idx").drop("rid2").withColumn("kind", F.lit(kind))

    # Types wait for no other one's last tasks.
    found = run_together(spark, {kind: partial(indexed, kind) for kind in m.ALL_TYPES})
    return merging.union_by_name(found.values())


# --- links -----------------------------------------------------------------


@query
def jn0_exceptions_remap(spark, sf_dir):
    """JN-0: the key by which tectonics and samples are looked up."""
    observations = mapped.observations(spark, sf_dir)
    listed = {**RULES.exceptions, "OB-8": None}
    return _named(link.remap_key(observations, "OBSID", listed, "key"), "OBSID", "key")


@query
def jn0_exceptions_table(spark, sf_dir):
    """JN-0: the same with a table of exceptions, one for every fifth order, a third of them without value."""
    given = mapped.table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    listed = given.selectExpr(
        "concat('OB-', o_orderkey) as key",
        "case when o_orderkey % 3 > 0 then concat('OB-', o_orderkey + 1) end as value",
    ).distinct()
    observations = mapped.observations(spark, sf_dir)
    return _named(link.remap_key(observations, "OBSID", listed, "key"), "OBSID", "key")


@query
def jn1_tectonic_link(spark, sf_dir):
    """JN-1: selected observations with their one tectonic id."""
    return _named(_linker(spark, sf_dir).tectonic_ids(), "OBSID", "GDB_ID", "n_ids")


@query
def jn2_planars(spark, sf_dir):
    """JN-2: observation to planar structures, over two keys."""
    return _named(_linker(spark, sf_dir).planars(), "OBSID", *m.CHILD_COLUMNS[m.PLANARS])


@query
def jn3_linears(spark, sf_dir):
    """JN-3: observation to linear structures, over two keys."""
    return _named(_linker(spark, sf_dir).linears(), "OBSID", *m.CHILD_COLUMNS[m.LINEARS])


@query
def jn4_images(spark, sf_dir):
    """JN-4: observation to images."""
    return _named(_linker(spark, sf_dir).images(), "OBSID", *m.CHILD_COLUMNS[m.IMAGES])


@query
def jn5_samples(spark, sf_dir):
    """JN-5: observation to samples, by the remapped key."""
    return _named(_linker(spark, sf_dir).samples(), "OBSID", *m.CHILD_COLUMNS[m.SAMPLES])


@query
def jn6_rocks(spark, sf_dir):
    """JN-6: observation to rock observations, one row per distinct rock."""
    rocks = _linker(spark, sf_dir).rocks()
    return _named(rocks, "OBSID", "REMARKS", "FIELD_NAME", "ROCK_NAME")


@query
def jn7_rock_textures(spark, sf_dir):
    """JN-7: rocks with their textures, NULL without any."""
    return _named(_linker(spark, sf_dir).rocks(), "OBSID", "ROCK_NAME", "ST_2")


@query
def jn8_textures(spark, sf_dir):
    """JN-8: all textures of all rocks of an observation."""
    return _named(_linker(spark, sf_dir).textures(), "OBSID", "ST_1", "ST_2")


@query
def jn9_image_files(spark, sf_dir):
    """JN-9: pictures and the files whose stem contains their id."""
    model = mapped.field_model(spark, sf_dir)
    return _named(img.link_files(model.images, mapped.image_files(model)), "PICTURE_ID", "n_files", "path")


@query
def jn10_recheck_flag(spark, sf_dir):
    """JN-10: which observations are listed for a recheck."""
    flagged = mrk.with_recheck(mapped.observations(spark, sf_dir), RULES.rechecks)
    return _named(flagged, "OBSID", "recheck")


@query
def jn10_recheck_table(spark, sf_dir):
    """JN-10: the same with a table of ids, one for every seventh order."""
    given = mapped.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    listed = given.selectExpr("concat('OB-', o_orderkey) as key")
    flagged = mrk.with_recheck(mapped.observations(spark, sf_dir), listed)
    return _named(flagged, "OBSID", "recheck")


@query
def jn11_missing_targets(spark, sf_dir):
    """JN-11: pictures without a file of their name."""
    model = mapped.field_model(spark, sf_dir)
    wanted = model.images.select(
        m.SRC, m.RID, F.concat(F.lit("in/"), "PICTURE_ID", F.lit(".jpg")).alias("path")
    )
    return _named(img.missing_targets(wanted, mapped.image_files(model)), "name")


@query
def jn12_layer_pairing(spark, sf_dir):
    """JN-12: layer arguments paired by position."""
    suppliers = mapped.table(spark, sf_dir, "supplier")
    customers = mapped.table(spark, sf_dir, "customer")
    datasets = suppliers.select(
        F.col("s_suppkey").alias("position"),
        F.concat(F.lit("layers/"), "s_name", F.lit(".geojson")).alias("value"),
    )
    named = customers.select(F.col("c_custkey").alias("position"), F.col("c_name").alias("value"))
    names = named.where(F.col("position") % 2 == 0)
    colors = suppliers.where(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("position"), F.lit("red").alias("value")
    )
    return lay.pair_by_position(datasets, name=names, color=colors)


# --- aggregates ------------------------------------------------------------


@query
def agg1_resolve_tectonic(spark, sf_dir):
    """AGG-1: one tectonic id per observation id of a source."""
    tectonics = mapped.field_model(spark, sf_dir).tectonics
    return _named(link.resolve_tectonic(tectonics, [m.SRC, "OBSID"]), "OBSID", "GDB_ID", "n_ids")


@query
def agg2_centre(spark, sf_dir):
    """AGG-2: the map centre of the selected observations."""
    chosen = selection.select_observations(mapped.observations(spark, sf_dir), RULES)
    at = mrk.centre(chosen)
    return at.select(F.round("LAT", 6).alias("lat"), F.round("LON", 6).alias("lon"))


@query
def agg3_texture_tuples(spark, sf_dir):
    """AGG-3: all textures of a rock as tuple text."""
    return _named(link.texture_tuples(mapped.field_model(spark, sf_dir).textures), "ROP_GID", "ST_2")


@query
def agg4_duplicate_ids(spark, sf_dir):
    """AGG-4: observation ids that occur more than once."""
    return mrk.duplicate_ids(mapped.observations(spark, sf_dir))


@query
def agg5_first_lineation(spark, sf_dir):
    """AGG-5: direction of the first linear structure."""
    first = mrk.first_lineations(_linker(spark, sf_dir).linears())
    return _named(first, F.col("DIRECTION").alias("angle"))


@query
def agg6_filter_metrics(spark, sf_dir):
    """AGG-6: rows before and after each rule, by type."""
    compiled = export.compile_types(mapped.field_model(spark, sf_dir), RULES)
    return merging.union_by_name(points.validity_metrics(df, kind) for kind, df in compiled.items())


@query
def dup1_distinct_rows(spark, sf_dir):
    """DUP-1: distinct planar rows per tectonic id, first kept."""
    planars = mapped.field_model(spark, sf_dir).planars
    keys = [m.SRC, "TM_GID", *m.CHILD_COLUMNS[m.PLANARS]]
    return _named(link.first_distinct(planars, keys, F.col(m.RID)), "TM_GID", "DIP", "STYPE")


@query
def dup2_first_marker(spark, sf_dir):
    """DUP-2: the first observation of each id over all sources."""
    return _named(mrk.first_per_id(mapped.observations(spark, sf_dir)), "OBSID", "LAT", "LON", "PROJECT")


@query
def nst1_nested_observations(spark, sf_dir):
    """NST-1: observations with six child lists, every field of each shown as text."""
    records = nested.nested_observations(_linker(spark, sf_dir))

    def as_text(kind: str) -> Column:
        def row(r: Column) -> Column:
            cells = [F.coalesce(r[c].cast("string"), F.lit("-")) for c in m.CHILD_COLUMNS[kind]]
            return F.concat_ws("|", *cells)

        return F.array_join(F.transform(kind, row), ";").alias(kind)

    return _named(records, "OBSID", "gdb_id", *[as_text(k) for k in m.ALL_TYPES])


# --- set operations --------------------------------------------------------


@query
def set1_union_rows(spark, sf_dir):
    """SET-1: planar and linear rows of all observations in one table."""
    linker = _linker(spark, sf_dir)
    stacked = merging.union_by_name([linker.planars(), linker.linears()])
    return _named(stacked, "OBSID", "STYPE", "DIP", "PLUNGE")


@query
def set2_merged_models(spark, sf_dir):
    """SET-2: two models merged; every row and cell of each table."""
    model = mapped.field_model(spark, sf_dir)
    left = model.with_observations(mrk.first_per_id(model.observations))

    def renamed(name: str, df: DataFrame) -> DataFrame:
        df = df.withColumn(m.SRC, F.concat(F.lit("other_"), m.SRC))
        return df.withColumn("OBSID", F.concat(F.lit("X"), "OBSID")) if "OBSID" in df.columns else df

    right = m.FieldModel.from_tables({n: renamed(n, df) for n, df in left.items()})
    merged = merging.merge_models(left, right)
    return merging.union_by_name(_cells(df, name) for name, df in merged.items())


@query
def set3_project_union(spark, sf_dir):
    """SET-3: project names of two lists, each once."""
    first = mapped.observations(spark, sf_dir).select("PROJECT")
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit("'"))
    second = mapped.table(spark, sf_dir, "customer").select(quoted.alias("PROJECT"))
    return merging.union_projects(first, merging.without_quotes(second))


@query
def set4_filtered_union(spark, sf_dir):
    """SET-4: the filtered observation tables of each project, stacked."""
    observations = mapped.observations(spark, sf_dir)
    parts = [selection.in_projects(observations, [p]) for p in RULES.projects]
    return _named(merging.union_by_name(parts), "OBSID", "PROJECT", "LAT", "LON")


# --- scalar functions ------------------------------------------------------


@query
def scl1_declination(spark, sf_dir):
    """SCL-1: azimuths corrected by several declinations."""
    linears = mapped.field_model(spark, sf_dir).linears
    azimuth = F.col("DIRECTION")
    return _named(
        linears,
        rules.correct_azimuth(azimuth, 8.0).alias("east"),
        rules.correct_azimuth(azimuth, -8.0).alias("west"),
        rules.correct_azimuth(azimuth, 400.0).alias("beyond"),
        rules.correct_azimuth(F.concat(F.lit(" "), azimuth.cast("string")), 8.0).alias("from_text"),
        rules.correct_azimuth(F.col("STYPE"), 8.0).alias("no_number"),
    )


@query
def scl2_dip_colour(spark, sf_dir):
    """SCL-2: colours of dips."""
    planars = mapped.field_model(spark, sf_dir).planars
    return _named(planars, rules.dip_colour(F.col("DIP")).alias("color"))


@query
def scl3_style_colour(spark, sf_dir):
    """SCL-3: layer styles with and without an own colour."""
    key = F.col("s_suppkey")
    style = F.when(key % 3 == 0, "Bedrock").when(key % 3 == 1, "Lineament")
    colour = F.when(key % 2 == 0, "red")
    made = rules.recolour(rules.style_map(style), colour)
    keys = ("color", "weight", "strokeColor", "fillOpacity")
    return mapped.table(spark, sf_dir, "supplier").select(
        "s_suppkey", *[F.try_element_at(made, F.lit(k)).alias(k) for k in keys]
    )


@query
def scl4_paths(spark, sf_dir):
    """SCL-4: base names, stems and shortened folders."""
    files = mapped.image_files(mapped.field_model(spark, sf_dir))
    path = F.concat(F.lit("/data/field/"), "path")
    return files.select(
        "path",
        text.base_name(path).alias("base"),
        text.stem(path).alias("stem"),
        text.shorten_folder(path, "/data/field/imgs").alias("short"),
    )


@query
def scl5_strip_quotes(spark, sf_dir):
    """SCL-5: both quote characters removed anywhere."""
    stripped = text.strip_quotes(F.col("html"))
    return mapped.table(spark, sf_dir, "pages").select("page_id", stripped.alias("html"))


@query
def scl6_stylesheet_link(spark, sf_dir):
    """SCL-6: a stylesheet link added to pages that can take one."""
    html = F.col("html")
    return mapped.styled_pages(spark, sf_dir).select(
        "page_id",
        text.stylesheet_status(html).alias("status"),
        text.link_stylesheet(html, "styles.css").alias("html"),
    )


@query
def scl7_thumbnail_size(spark, sf_dir):
    """SCL-7: heights at a fixed width."""
    files = mapped.image_files(mapped.field_model(spark, sf_dir))
    height = rules.thumbnail_height(F.col("width"), F.col("height"), 800)
    return files.select("path", "width", "height", height.cast("long").alias("new_height"))


# --- markers ---------------------------------------------------------------


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = mapped.field_model(spark, sf_dir)
    return webmap.compile_markers(model, RULES, mapped.image_files(model), "imgs")


@query
def mrk1_marker_icons(spark, sf_dir):
    """MRK-1: place, icon, colour and angle of each marker."""
    return _markers(spark, sf_dir).select(
        "OBSID", "LAT", "LON", "tooltip", "icon", "color", "angle"
    )


@query
def mrk2_popup_tables(spark, sf_dir):
    """MRK-2: rendered rows of all structures."""
    linker = _linker(spark, sf_dir)

    def rendered(kind: str) -> DataFrame:
        rows = linker.of_type(kind)
        shown = _named(rows, mrk.table_rows(rows, kind).alias("html"), F.lit(kind).alias("kind"))
        return shown.drop("rid2")

    return merging.union_by_name(rendered(kind) for kind, _ in mrk.SECTIONS)


@query
def mrk3_popups(spark, sf_dir):
    """MRK-3: popup documents without an image folder."""
    model = mapped.field_model(spark, sf_dir)
    return webmap.compile_markers(model, RULES).select("OBSID", "popup")


@query
def mrk4_image_blocks(spark, sf_dir):
    """MRK-4: the images part of each popup."""
    return _markers(spark, sf_dir).select(
        "OBSID", F.regexp_extract("popup", r"(?s)<h4>Images</h4>(.*)$", 1).alias("block")
    )


@query
def mrk5_markers(spark, sf_dir):
    """MRK-5: the whole marker set."""
    return _markers(spark, sf_dir)


# --- validation ------------------------------------------------------------


@query
def val2_contract_violations(spark, sf_dir):
    """VAL-2: rows that miss a value a run cannot do without."""
    model = mapped.field_model(spark, sf_dir)
    holes = {
        m.OBSERVATION: model.observations.withColumns(
            {
                "REMARKS": F.nullif("REMARKS", F.lit("P")),
                "LAT": F.when(F.col("LAT") < 69.0, F.col("LAT")),
            }
        ),
        m.IMAGE: model.images.withColumn("REMARKS", F.nullif("REMARKS", F.lit("pic 3"))),
        m.ROCK: model.rocks,
    }
    return _named(validation.violations(holes), "table_name", "column_name", "reason")


#: What is wrong with the databases that VAL-1 and VAL-2 look at.
SPOILED = {m.PLANAR: ("DIP", 23), m.OBSERVATION: ("LAT", 41)}
LACKING = {m.IMAGE: ("db1-", "REMARKS"), m.TEXTURE: ("db2-", None)}


@query
def val2_mistyped_cells(spark, sf_dir):
    """VAL-2: text in numeric cells, as the scan of the databases notes it."""
    folder = _written_databases(spark, sf_dir, texts=SPOILED)
    found = [mistyped_cells(spark, folder, t) for t in (m.OBSERVATION, m.PLANAR, m.LINEAR)]
    return _named(
        _database_of(merging.union_by_name(found)), "table_name", "column_name", "reason"
    )


@query
def val1_schema_violations(spark, sf_dir):
    """VAL-1: tables and columns that databases lack, all of them at once."""
    found = schema_violations(spark, _written_databases(spark, sf_dir, without=LACKING))
    return found.select(F.col(m.SRC).alias("src"), "table_name", "column_name", "reason")


@query
def val3_all_points(spark, sf_dir):
    """VAL-3: compiled rows without a point, of each type."""
    compiled = export.compile_types(mapped.field_model(spark, sf_dir), RULES)
    return merging.union_by_name(
        points.point_counts(df).withColumn("kind", F.lit(kind)) for kind, df in compiled.items()
    )


# --- images ----------------------------------------------------------------


@query
def img1_resize_manifest(spark, sf_dir):
    """IMG-1: what a resize run does with each file."""
    files = mapped.image_files(mapped.field_model(spark, sf_dir)).distinct()
    sized = files.withColumn("width", F.when(F.col("width") % 10 == 0, -1).otherwise(F.col("width")))
    done = files.where(F.col("width") % 4 == 0)
    manifest = img.resize_manifest(sized, done)
    return manifest.withColumns({c: F.col(c).cast("long") for c in ("new_width", "new_height")})


@query
def img2_resample(spark, sf_dir):
    """IMG-2: nearest-neighbour thumbnails of small grey images."""
    thumbs = img.resample(derived.small_images(spark, sf_dir), 24)
    return thumbs.select("path", "width", "height", F.hex("data").alias("pixels"))


@query
def src5_image_listing(spark, sf_dir):
    """SRC-5: the images of a folder with their sizes, unread."""
    listed = list_images(spark, derived.image_folder(spark, sf_dir), "png")
    return listed.select(text.base_name(F.col("path")).alias("name"), "length")


@query
def src6_decoded_images(spark, sf_dir):
    """SRC-6: the images of a folder decoded; a file that is none stays as such."""
    images = read_images(spark, derived.image_folder(spark, sf_dir), "png")
    return images.select(
        text.base_name(F.col("path")).alias("name"), "width", "height", "channels", F.hex("data").alias("pixels")
    )


@query
def pip5_thumbnails(spark, sf_dir):
    """PIP-5: a resize run over a folder; some thumbnails exist already."""
    origin = derived.image_folder(spark, sf_dir)
    destination = derived.scratch(spark, "thumbnails")
    every = list_images(spark, origin, "png").select("path")
    number = F.regexp_extract("path", r"v(\d+)\.png$", 1).cast("long")
    done = every.where(number % 5 == 0)
    thumbnails.resize_images(spark, origin, destination, done, 24, "png")
    stored = thumbnails.stored_thumbnails(spark, destination)
    return stored.select("name", "width", "height", F.hex("data").alias("pixels"))


# --- layers and sources ----------------------------------------------------


def _written_databases(spark: SparkSession, sf_dir: str, **wrong: dict) -> str:
    """A folder with the field tables as databases, one per source and range of keys."""
    folder = derived.scratch(spark, "databases")
    given = mapped.field_model(spark, sf_dir)
    parts = {t: derived.with_block(df, t) for t, df in given.items()}
    files = derived.field_databases(m.FieldModel.from_tables(parts), "1", **wrong)
    derived.write_files(files, folder)
    return folder


def _database_of(df: DataFrame) -> DataFrame:
    """Sources under their names before they were cut into databases."""
    return df.withColumn(m.SRC, F.regexp_extract(F.col(m.SRC), r"^(.*)-\d+@1\.sqlite$", 1))


@query
def src1_sqlite_scan(spark, sf_dir):
    """SRC-1: observations read back from a folder of databases."""
    rows = read_table(spark, _written_databases(spark, sf_dir), m.OBSERVATION)
    return _named(_database_of(rows), *m.TABLE_COLUMNS[m.OBSERVATION])


@query
def src1_filtered_scan(spark, sf_dir):
    """SRC-1: observations of one project and range of row ids, filtered where databases are read."""
    folder = _written_databases(spark, sf_dir)
    rows = read_table(spark, folder, m.OBSERVATION)
    chosen = rows.where((F.col("PROJECT") == "2-HIGH") & (F.col(m.RID) > 100) & (F.col("LAT") < 66.0))
    return _named(_database_of(chosen), *m.TABLE_COLUMNS[m.OBSERVATION])


@query
def src1_parsed_databases(spark, sf_dir):
    """SRC-1: observations read back from databases that are rows themselves."""
    files = derived.databases(mapped.observations(spark, sf_dir), m.OBSERVATION)
    rows = parse_databases(files, m.OBSERVATION)
    source = F.regexp_extract(F.col(m.SRC), r"^(.*)-\d+\.sqlite$", 1)
    return _named(rows.withColumn(m.SRC, source), *m.TABLE_COLUMNS[m.OBSERVATION])


@query
def src2_eight_tables(spark, sf_dir):
    """SRC-2, SRC-3: all tables of a folder of databases, every row and cell as text."""
    model = load_model(spark, _written_databases(spark, sf_dir))
    return merging.union_by_name(_cells(_database_of(df), table) for table, df in model.items())


@query
def src3_databases_of_folder(spark, sf_dir):
    """SRC-3: which databases a folder holds, and how many observations each."""
    folder = _written_databases(spark, sf_dir)
    per = read_table(spark, folder, m.OBSERVATION, ["OBSID"]).groupBy(m.SRC)
    return per.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("OBSID").alias("n_ids")).select(
        F.col(m.SRC).alias("src"), "n", "n_ids"
    )


@query
def src4_geojson_features(spark, sf_dir):
    """SRC-4: features of GeoJSON documents."""
    features = parse_documents(derived.layer_documents(spark, sf_dir))
    label = F.try_element_at("properties", F.lit("name")).alias("label")
    flat = _each_vertex(features.withColumn("label", label), "dataset", "feature_no", "epsg", "geometry_type", "label")
    return flat.select(
        *[c for c in flat.columns if c not in ("nth", "v")],
        F.col("nth").cast("long").alias("nth"),
        F.col("v")[0].alias("x"),
        F.col("v")[1].alias("y"),
    )


@query
def src4_feature_lines(spark, sf_dir):
    """SRC-4: features written one per line, whatever a line begins with, and read by path."""
    folder = derived.scratch(spark, "lines")
    derived.feature_lines(spark, sf_dir).write.text(folder)
    features = read_lines(spark, folder, 3067)
    key = F.col("properties")["key"].cast("long")
    return _each_vertex(features.withColumn("key", key), "key", "epsg", "geometry_type").select(
        "key",
        "epsg",
        "geometry_type",
        F.col("nth").cast("long").alias("nth"),
        F.col("v")[0].alias("x"),
        F.col("v")[1].alias("y"),
    )


@query
def src7_rule_rows(spark, sf_dir):
    """SRC-7: rule files as rows."""
    return parse_rules(derived.rule_texts(spark, sf_dir))


@query
def src7_rule_scalars(spark, sf_dir):
    """SRC-7: declination and box of each rule file."""
    return rule_scalars(parse_rules(derived.rule_texts(spark, sf_dir)))


@query
def geo5_layer_features(spark, sf_dir):
    """GEO-5: layer features in geographic coordinates, named and styled."""
    documents = derived.layer_documents(spark, sf_dir)
    number = F.regexp_extract("dataset", r"(\d+)", 1).cast("int")
    specs = lay.named_by_stem(
        documents.select(
            number.alias("position"),
            "dataset",
            F.lit(None).cast("string").alias("name"),
            F.when(number % 2 == 0, "name").otherwise("").alias("popup_field"),
            F.lit("Lineament").alias("style"),
            F.when(number % 3 == 0, "green").alias("color"),
        )
    )
    features = lay.to_geographic(parse_documents(documents), [3067])
    styled = lay.styled_features(features, specs)
    return _each_vertex(
        styled, "position", "name", "feature_no", "popup", "geometry_type", "style"
    ).select(
        "position",
        "name",
        "feature_no",
        "popup",
        "geometry_type",
        F.col("style")["color"].alias("color"),
        F.col("style")["weight"].alias("weight"),
        F.col("nth").cast("long").alias("nth"),
        F.round(F.col("v")[0], 9).alias("lon"),
        F.round(F.col("v")[1], 9).alias("lat"),
    )


# --- whole runs ------------------------------------------------------------


@query
def pip1_selected_observations(spark, sf_dir):
    """PIP-1: observations by project and box, over all sources."""
    chosen = selection.select_observations(mapped.observations(spark, sf_dir), RULES)
    return _named(chosen, "OBSID", "LAT", "LON", "REMARKS", "PROJECT")


@query
def pip2_planars(spark, sf_dir):
    """PIP-2: planar structures before the validity filter."""
    return _dataset(_points(spark, sf_dir, m.PLANARS))


@query
def pip2_linears(spark, sf_dir):
    """PIP-2: linear structures before the validity filter."""
    return _dataset(_points(spark, sf_dir, m.LINEARS))


@query
def pip2_rock_observations(spark, sf_dir):
    """PIP-2: rock observations."""
    return _dataset(_points(spark, sf_dir, m.ROCKS))


@query
def pip2_images(spark, sf_dir):
    """PIP-2: images."""
    return _dataset(_points(spark, sf_dir, m.IMAGES))


@query
def pip2_samples(spark, sf_dir):
    """PIP-2: samples."""
    return _dataset(_points(spark, sf_dir, m.SAMPLES))


@query
def pip2_textures(spark, sf_dir):
    """PIP-2: textures."""
    return _dataset(_points(spark, sf_dir, m.TEXTURES))


@query
def snk1_csv_linears(spark, sf_dir):
    """SNK-1: linear structures written as CSV and read back."""
    folder = derived.scratch(spark, "csv")
    compiled = _points(spark, sf_dir, m.LINEARS)
    point_sink.write_types({m.LINEARS: compiled}, folder, ["csv"])
    schema = (
        "row_idx long, REMARKS string, DIRECTION double, PLUNGE double, STYPE_TEXT string, "
        "STYPE string, OBSID string, OBS_REMARKS string, PROJECT string, x double, y double, z double"
    )
    read = spark.read.schema(schema).options(**point_sink.CSV_OPTIONS)
    return _metres(read.csv(f"{folder}/linears.csv"))


@query
def snk2_parquet_samples(spark, sf_dir):
    """SNK-2: samples written with geometry and read back."""
    folder = derived.scratch(spark, "parquet")
    point_sink.write_types(
        {m.SAMPLES: _points(spark, sf_dir, m.SAMPLES)}, folder, ["parquet"]
    )
    rows = spark.read.parquet(f"{folder}/samples.parquet").withColumn("wkb", F.hex("geometry"))

    def leading_bits(first: int) -> Column:
        """Sign, exponent and the next 28 bits of a little-endian double."""
        pairs = [F.substring("wkb", first + 2 * i, 2) for i in reversed(range(3, 8))]
        return F.lpad(F.conv(F.concat(*pairs), 16, 2), 40, "0")

    return _metres(
        rows.select(
            *[c for c in rows.columns if c not in ("geometry", "z", "wkb")],
            F.length("geometry").alias("n_bytes"),
            F.substring("wkb", 1, 10).alias("head"),
            leading_bits(11).alias("x_bits"),
            leading_bits(27).alias("y_bits"),
        )
    )


@query
def snk2_geojson_images(spark, sf_dir):
    """SNK-2: images written as GeoJSON lines and read back."""
    folder = derived.scratch(spark, "geojson")
    point_sink.write_types(
        {m.IMAGES: _points(spark, sf_dir, m.IMAGES)}, folder, ["geojson"]
    )
    schema = (
        "type string, crs struct<properties: struct<name: string>>, properties struct<OBSID: string, "
        "PICTURE_ID: string, REMARKS: string, OBS_REMARKS: string, PROJECT: string>, "
        "geometry struct<type: string, coordinates: array<double>>"
    )
    rows = spark.read.schema(schema).json(f"{folder}/images.geojson")
    at = F.col("geometry.coordinates")
    return rows.select(
        "properties.*",
        F.col("crs.properties.name").alias("crs"),
        F.col("geometry.type").alias("shape"),
        F.round(at[0], 3).alias("x"),
        F.round(at[1], 3).alias("y"),
    )


@query
def snk3_written_types(spark, sf_dir):
    """SNK-3, PIP-3: a whole export run; the rows it wrote, of all types."""
    folder = derived.scratch(spark, "export")
    export.export_observations(mapped.field_model(spark, sf_dir), RULES, folder)

    def written(kind: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{kind}.parquet")
        remarks = "OBS_REMARKS" if "OBS_REMARKS" in rows.columns else "REMARKS"
        own = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in m.CHILD_COLUMNS[kind]]
        return rows.select(
            F.lit(kind).alias("kind"), F.concat_ws("|", *own).alias("own"), "OBSID",
            F.col(remarks).alias("remarks"), "PROJECT", "x", "y", "z", "epsg",
        )

    return _metres(merging.union_by_name(written(kind) for kind in m.ALL_TYPES))


@query
def snk4_marker_lines(spark, sf_dir):
    """SNK-4, PIP-4: markers written as GeoJSON lines and read back."""
    folder = derived.scratch(spark, "markers")
    marker_sink.write_markers(_markers(spark, sf_dir), folder)
    schema = (
        "properties struct<tooltip: string, icon: string, color: string, angle: double, "
        "popup: string>, geometry struct<coordinates: array<double>>"
    )
    rows = spark.read.text(f"{folder}/markers.geojson").select(
        "PROJECT", F.from_json("value", schema).alias("f")
    )
    at = F.col("f.geometry.coordinates")
    return rows.select(
        "PROJECT", "f.properties.*", at[0].alias("lon"), at[1].alias("lat")
    )


@query
def pip4_webmap_layers(spark, sf_dir):
    """PIP-4, JN-12, GEO-5: a whole map run with layers given by their paths."""
    folder = derived.scratch(spark, "webmap")
    lines = derived.feature_lines(spark, sf_dir, "part")
    lines.write.partitionBy("part").text(f"{folder}/given")
    paths = [f"{folder}/given/part={n}" for n in range(3)]
    webmap.compile_webmap(
        spark,
        mapped.field_model(spark, sf_dir),
        RULES,
        f"{folder}/map",
        datasets=paths,
        names=["First", "Second"],
        popup_fields=["key"],
        styles=[None, "Lineament", "Wide"],
        colors=["green"],
        own_styles={"Wide": {"weight": "7"}},
        read_layer=partial(read_lines, epsg=3067),
    )
    features = spark.read.text(f"{folder}/map/layers.geojson").select(
        F.from_json(
            "value",
            "properties struct<name: string, style: map<string,string>, popup: string, "
            "properties: map<string,string>>, geometry struct<type: string, coordinates: string>",
        ).alias("f")
    )
    rows = features.select(
        "f.properties.name",
        F.try_element_at("f.properties.style", F.lit("weight")).alias("weight"),
        F.col("f.properties.popup").alias("popup"),
        F.col("f.properties.properties")["key"].cast("long").alias("key"),
        lay.vertices(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("vertices"),
    )
    return _each_vertex(rows, "name", "weight", "popup", "key").select(
        "name",
        "weight",
        "popup",
        "key",
        F.col("nth").cast("long").alias("nth"),
        F.round(F.col("v")[0], 9).alias("lon"),
        F.round(F.col("v")[1], 9).alias("lat"),
    )


@query
def dup2_skipped_observations(spark, sf_dir):
    """DUP-2: observations that repeat an id and show no marker."""
    found = mrk.skipped_observations(mapped.observations(spark, sf_dir))
    return found.select(F.col(m.SRC).alias("src"), F.col(m.RID).alias("orid"), "OBSID", "n")


@query
def agg1_ambiguous_observations(spark, sf_dir):
    """AGG-1: selected observations with several tectonic ids."""
    return _named(_linker(spark, sf_dir).ambiguous_observations(), "OBSID", "GDB_ID", "n_ids")


@query
def flt2_antimeridian_box(spark, sf_dir):
    """FLT-2: a box of the first zone that reaches beyond 180 degrees."""
    moved = mapped.observations(spark, sf_dir).withColumn(
        "LON", F.when(F.col("LON") < 26, F.col("LON") - 200).otherwise(F.col("LON") + 148)
    )
    chosen = selection.within_bounds(moved, (150000.0, 6600000.0, 450000.0, 7800000.0), 32601)
    return _named(chosen, "OBSID", "LON")


@query
def pip6_newest_snapshots(spark, sf_dir):
    """PIP-6: orders landed as snapshots, picked up by a stream; newest rows."""
    folder = derived.scratch(spark, "landed")
    schema = mapped.table(spark, sf_dir, "orders").schema
    watch = snapshots.watch_tables(
        spark, sf_dir, schema, f"{folder}/tables", f"{folder}/checkpoint", names="orders.parquet"
    )
    watch.awaitTermination()
    landed = spark.read.parquet(f"{folder}/tables").select(
        "o_orderkey",
        F.concat(F.lit("team"), (F.col("o_custkey") % 40).cast("string")).alias(m.SRC),
        # Without leading zeros, so that the order of the texts is not that of the months.
        F.concat(F.year("o_orderdate"), F.lit("-"), F.month("o_orderdate")).alias(snapshots.SNAPSHOT),
    )
    newest = snapshots.newest_snapshots(landed)
    return _named(newest, "o_orderkey", F.col(snapshots.SNAPSHOT).alias("snapshot"))


#: What the second landing does to the sources of one name.
CHANGED, ADDED, STALE = "db1", "db2", "db0"


def _landed_twice(spark: SparkSession, sf_dir: str) -> tuple[LandedTables, str]:
    """Databases that land in two rounds, each picked up by a stream that exports again.

    The second round changes some sources, adds some, and brings older snapshots of others.
    """
    folder = derived.scratch(spark, "landings")
    landing, tables, out = (f"{folder}/{n}" for n in ("landing", "tables", "export"))
    given = mapped.field_model(spark, sf_dir)
    name = F.col(m.SRC)

    def land(model: dict[str, DataFrame], snapshots_of: dict[str, str]) -> None:
        snapshot = F.coalesce(*[F.when(name == n, F.lit(s)) for n, s in snapshots_of.items()])
        own = {
            t: derived.with_block(
                df.where(name.isin([*snapshots_of])).withColumn(snapshots.SNAPSHOT, snapshot), t
            )
            for t, df in model.items()
        }
        files = derived.field_databases(m.FieldModel.from_tables(own), F.col(snapshots.SNAPSHOT))
        derived.write_files(files, landing)

    def watch() -> None:
        snapshots.watch_exports(
            spark, landing, f"{folder}/checkpoint", tables, RULES, out
        ).awaitTermination()

    kept = name == ADDED
    remarks = F.when(kept, F.col("REMARKS")).otherwise(F.concat("REMARKS", F.lit("+")))
    marked = given.observations.withColumn("REMARKS", remarks)
    fewer = given.planars.where(kept | (F.col(m.RID) % 4 != 0))
    land(dict(given.items()), {STALE: "9", CHANGED: "9"})
    watch()
    changes = {m.OBSERVATION: marked, m.PLANAR: fewer}
    land(dict(given.items()) | changes, {CHANGED: "10", ADDED: "2024-1", STALE: "8"})
    watch()
    return LandedTables(spark, tables), out


@query
def pip6_landed_tables(spark, sf_dir):
    """PIP-6: rows after two landings, with the snapshot and the batch that each source is from."""
    store, _ = _landed_twice(spark, sf_dir)
    model = store.model()
    observations = model.observations.select(
        m.SRC, m.RID, F.lit("observation").alias("kind"), "OBSID", F.col("REMARKS").alias("value")
    )
    planars = model.planars.select(
        m.SRC, m.RID, F.lit("planar").alias("kind"), F.col("TM_GID").alias("OBSID"),
        F.col("DIP").cast("int").cast("string").alias("value"),
    )
    rows = observations.unionByName(planars).join(store.current(), m.SRC)
    return _named(
        rows, "kind", F.col("OBSID").alias("key"), "value",
        F.col(snapshots.SNAPSHOT).alias("snapshot"), F.col("landed").alias("batch"),
    )


@query
def pip6_landed_export(spark, sf_dir):
    """PIP-6: planar structures as the second landing's export left them."""
    _, out = _landed_twice(spark, sf_dir)
    rows = spark.read.parquet(f"{out}/{m.PLANARS}.parquet")
    return _metres(rows.drop("geometry", "epsg"))
