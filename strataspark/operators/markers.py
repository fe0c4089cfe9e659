"""Map markers: one per observation id, with icon, popup and centre."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark import model as m
from strataspark.functions.text import cell_sql, escaped_sql, row_sql, shorten_folder
from strataspark.operators.images import link_files
from strataspark.operators.linking import Linker, group_by_piece, piece_of, sorted_items

# Popup sections in their order.
SECTIONS = (
    (m.PLANARS, "Planar Structures"),
    (m.LINEARS, "Linear Structures"),
    (m.ROCKS, "Rock Observations"),
    (m.SAMPLES, "Samples"),
    (m.TEXTURES, "Textures"),
)
IMAGE_SECTION = len(SECTIONS) + 1
LINEAR_SECTION = 2
# The first images of an observation are shown, the others linked.
SHOWN_IMAGES = 2

# Icons and colours.
ARROW_ICON, STOP_ICON = "glyphicon-arrow-up", "glyphicon-stop"
ARROW_COLOUR, STOP_COLOUR, RECHECK_COLOUR = "blue", "lightgray", "red"

# Rechecks up to this many ids are a literal list, beyond it a join.
_LITERAL_IDS = 1000


def first_per_id(observations: DataFrame) -> DataFrame:
    """The first observation of each id over all sources.

    First by source name, then row id.  An aggregate, so copies of one id are
    reduced where they are read.
    """
    others = [c for c in observations.columns if c != "OBSID"]
    rid = m.OBS_RID if m.OBS_RID in others else m.RID
    whole = F.struct(*others)
    return (
        observations.groupBy("OBSID")
        .agg(F.min_by(whole, F.struct(m.SRC, rid)).alias("_first"))
        .select("OBSID", *[F.col("_first")[c].alias(c) for c in others])
        .select(*observations.columns)
    )


def skipped_observations(observations: DataFrame) -> DataFrame:
    """Observations that :func:`first_per_id` leaves out: ``OBSID, _src``, their row id, ``n``.

    ``n`` counts the observations of the id.  Ids that occur once need no second look, so
    only repeated ones are joined.
    """
    rid = m.OBS_RID if m.OBS_RID in observations.columns else m.RID
    first = F.min(F.struct(m.SRC, rid)).alias("_first")
    repeated = (
        observations.where(F.col("OBSID").isNotNull())
        .groupBy("OBSID")
        .agg(F.count(F.lit(1)).alias("n"), first)
        .where("n > 1")
    )
    return (
        observations.join(repeated, "OBSID")
        .where(F.struct(m.SRC, rid) != F.col("_first"))
        .select("OBSID", m.SRC, rid, "n")
    )


def duplicate_ids(observations: DataFrame) -> DataFrame:
    """Observation ids that occur more than once, with their counts."""
    return (
        observations.groupBy("OBSID")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("OBSID").isNotNull())
    )


def centre(observations: DataFrame) -> DataFrame:
    """Mean latitude and longitude, each over its known values."""
    return observations.agg(F.avg("LAT").alias("LAT"), F.avg("LON").alias("LON"))


def known_centre(observations: DataFrame) -> tuple[float, float]:
    """The centre as numbers; no known coordinate raises."""
    row = centre(observations).first()
    if row["LAT"] is None or row["LON"] is None:
        raise ValueError("no observation with coordinates to centre the map on")
    return row["LAT"], row["LON"]


def with_recheck(observations: DataFrame, rechecks: Iterable[str] | DataFrame) -> DataFrame:
    """Add ``recheck``: whether the id is listed, in the driver or in a table with ``key``."""
    if isinstance(rechecks, DataFrame):
        return _flagged(observations, rechecks)
    listed = sorted(set(rechecks))
    if len(listed) <= _LITERAL_IDS:
        flag = F.coalesce(F.col("OBSID").isin(listed), F.lit(False))
        return observations.withColumn("recheck", flag)
    rows = observations.sparkSession.createDataFrame([(i,) for i in listed], "key string")
    return _flagged(observations, rows)


def _flagged(observations: DataFrame, listed: DataFrame) -> DataFrame:
    rows = listed.select(F.col("key").alias("OBSID")).distinct()
    return observations.join(rows.withColumn("recheck", F.lit(True)), "OBSID", "left").withColumn(
        "recheck", F.coalesce(F.col("recheck"), F.lit(False))
    )


def first_lineations(linears: DataFrame) -> DataFrame:
    """Direction of each observation's first linear structure, uncorrected."""
    return linears.groupBy(m.SRC, m.OBS_RID).agg(
        F.min_by("DIRECTION", m.RID).alias("DIRECTION")
    )


def popup_columns(kind: str) -> list[str]:
    """Columns a popup table shows: all of the child's but its remarks."""
    return [c for c in m.CHILD_COLUMNS[kind] if c != "REMARKS"]


def table_rows(df: DataFrame, kind: str) -> Column:
    """One HTML table row per child row."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return F.expr(row_sql([cell_sql(c, c in doubles) for c in popup_columns(kind)]))


def table_open(kind: str, label: str) -> str:
    """Heading and head row of a popup section."""
    head = "".join(f"<th>{c}</th>" for c in popup_columns(kind))
    return f"<h4>{label}</h4>\n<table><tr>{head}</tr>"


def _section_rows(linker: Linker) -> DataFrame:
    """Child rows of all types in one long table of rendered rows."""
    parts = []
    for number, (kind, _) in enumerate(SECTIONS, start=1):
        rows = linker.of_type(kind)
        order = linker.order_columns(kind)
        second = F.col(order[1]) if len(order) > 1 else F.lit(0)
        direction = F.col("DIRECTION") if kind == m.LINEARS else F.lit(None)
        parts.append(
            rows.select(
                m.SRC,
                m.OBS_RID,
                F.lit(number).alias("section"),
                piece_of(order).alias("_block"),
                F.col(m.RID).alias("k1"),
                second.cast("long").alias("k2"),
                table_rows(rows, kind).alias("html"),
                F.lit(None).cast("string").alias("link"),
                F.lit(True).alias("found"),
                direction.cast("double").alias("DIRECTION"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _image_rows(linker: Linker, files: DataFrame | None) -> DataFrame:
    """Images rendered both shown and linked."""
    rows = linker.images()
    if files is None:
        rows = rows.selectExpr("*", "0 as n_files", "cast(null as string) as path")
    else:
        rows = link_files(rows, files)
    path, caption, picture = (escaped_sql(c) for c in ("path", "REMARKS", "PICTURE_ID"))
    opened = f"""'<a href="', {path}, '">'"""
    shown = f"""concat({opened}, '<img alt="', {caption}, '" src="', {path}, '"/></a>\n')"""
    linked = f"concat('\n', {opened}, {picture}, ': ', {caption}, '</a>')"
    return rows.select(
        m.SRC,
        m.OBS_RID,
        F.lit(IMAGE_SECTION).alias("section"),
        piece_of([m.RID]).alias("_block"),
        F.col(m.RID).alias("k1"),
        F.lit(0).cast("long").alias("k2"),
        F.expr(f"coalesce({shown}, '')").alias("html"),
        F.expr(f"coalesce({linked}, '')").alias("link"),
        F.expr("n_files = 1 and REMARKS is not null").alias("found"),
        F.lit(None).cast("double").alias("DIRECTION"),
    )


def _popup_pieces(rows: DataFrame) -> DataFrame:
    """Per observation: its sections' pieces in order, and its first lineation.

    Rows are sorted and joined in pieces of bounded length; what meets per
    observation is the pieces' finished text.
    """
    item = F.struct("html", "link")
    lineation = F.col("section") == LINEAR_SECTION
    grouped = group_by_piece(rows, [m.SRC, m.OBS_RID, "section"]).agg(
        sorted_items(["k1", "k2"], item).alias("items"),
        F.bool_and("found").alias("found"),
        F.min(F.when(lineation, F.col("k1"))).alias("_line_rid"),
        F.min_by("DIRECTION", F.when(lineation, F.col("k1"))).alias("DIRECTION"),
    )
    section = F.col("_g")["section"]
    image = section == IMAGE_SECTION
    html = F.transform("items", lambda i: i["html"])
    pieces = grouped.select(
        F.col("_g")[m.SRC].alias(m.SRC),
        F.col("_g")[m.OBS_RID].alias(m.OBS_RID),
        F.struct(
            section.alias("section"),
            F.col("_g")["_block"].alias("block"),
            F.when(~image, F.array_join(html, "")).alias("text"),
            F.when(image, F.slice(html, 1, SHOWN_IMAGES)).alias("shown"),
            F.when(image, F.transform("items", lambda i: i["link"])).alias("links"),
            "found",
        ).alias("piece"),
        "_line_rid",
        "DIRECTION",
    )
    return pieces.groupBy(m.SRC, m.OBS_RID).agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.min_by("DIRECTION", "_line_rid").alias("angle"),
        F.min("_line_rid").isNotNull().alias("has_linears"),
    )


def _of_section(number: int) -> str:
    return f"filter(pieces, p -> p.section = {number})"


def _image_block_sql(files_known: bool) -> str:
    """SQL: the images of an observation; one unmatched image discards all.

    Folds over the pieces: what is still to be shown of a piece, then links.
    """
    if not files_known:
        return "'\n'"
    left = f"greatest(0, {SHOWN_IMAGES} - acc.n)"
    shown = f"array_join(slice(p.shown, 1, {left}), '')"
    linked = f"array_join(slice(p.links, least({left}, size(p.links)) + 1, size(p.links)), '')"
    step = f"named_struct('n', acc.n + size(p.links), 'text', concat(acc.text, {shown}, {linked}))"
    images = _of_section(IMAGE_SECTION)
    fold = f"aggregate({images}, named_struct('n', 0, 'text', '\n'), (acc, p) -> {step}).text"
    return f"if(forall({images}, p -> p.found), {fold}, '\n')"


def popup_html(files_known: bool) -> Column:
    """The popup document, from ``OBSID``, ``OBS_REMARKS`` and ``pieces``."""
    parts = ["'<h3>'", escaped_sql("OBSID"), "'</h3>\n'"]
    for number, (kind, label) in enumerate(SECTIONS, start=1):
        rows = f"array_join(transform({_of_section(number)}, p -> p.text), '')"
        table = f"concat('{table_open(kind, label)}', {rows}, '</table>\n')"
        parts.append(f"if(exists(pieces, p -> p.section = {number}), {table}, '')")
    remarks = f"coalesce({escaped_sql('OBS_REMARKS')}, '')"
    parts += ["'<h4>Observation remarks</h4>\n<p>'", remarks, "'</p>\n'"]
    block = f"concat('<h4>Images</h4>\n', {_image_block_sql(files_known)})"
    parts.append(f"if(exists(pieces, p -> p.section = {IMAGE_SECTION}), {block}, '\n')")
    return F.expr(f"replace(concat({', '.join(parts)}), 'src=', 'height=150 src=')")


def icon_columns() -> dict[str, Column]:
    """Icon, colour and angle from ``has_linears``, ``recheck``, ``angle``."""
    plain = F.when(F.col("has_linears"), ARROW_COLOUR).otherwise(STOP_COLOUR)
    return {
        "icon": F.when(F.col("has_linears"), ARROW_ICON).otherwise(STOP_ICON),
        "color": F.when(F.col("recheck"), RECHECK_COLOUR).otherwise(plain),
        "angle": F.when(F.col("has_linears"), F.col("angle")),
    }


def markers(
    linker: Linker,
    files: DataFrame | None,
    rechecks: Iterable[str] | DataFrame = (),
    image_folder: str | None = None,
) -> DataFrame:
    """One marker per observation of the linker.

    ``OBSID, PROJECT, LAT, LON, tooltip, icon, color, angle, popup``.  The
    observations must already be first per id.  With ``image_folder``, that
    path is shortened to its last component in the popups.
    """
    # One observation per id, so its id, source and row id stand for all of it until the last join.
    narrow = linker.narrowed
    rows = _section_rows(narrow).unionByName(_image_rows(narrow, files))
    gathered = _popup_pieces(rows)
    joined = linker.observations.join(gathered, [m.SRC, m.OBS_RID], "left").withColumns(
        {
            "pieces": F.coalesce("pieces", F.array().cast(gathered.schema["pieces"].dataType)),
            "has_linears": F.coalesce("has_linears", F.lit(False)),
        }
    )
    popup = popup_html(files is not None)
    if image_folder is not None:
        popup = shorten_folder(popup, image_folder)
    return (
        with_recheck(joined, rechecks)
        .withColumns({**icon_columns(), "popup": popup})
        .select(
            "OBSID",
            "PROJECT",
            "LAT",
            "LON",
            F.col("OBSID").alias("tooltip"),
            "icon",
            "color",
            "angle",
            "popup",
        )
    )
