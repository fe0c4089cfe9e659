"""Value rules, texts and projections against plain Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from strataspark.functions import geo, rules, text


def turned(azimuth, declination):
    """The correction as a person would do it on paper."""
    if azimuth is None or math.isnan(azimuth) or not 0 <= azimuth <= 360:
        return azimuth
    if not isinstance(declination, float) or math.isnan(declination) or abs(declination) > 360:
        return azimuth
    total = azimuth + declination
    return total - 360 if total > 360 else total + 360 if total < 0 else total


@pytest.mark.parametrize("declination", [8.0, -8.0, 0.0, 360.0, -360.0, 400.0, math.nan, 8, None])
def test_declination(spark, declination):
    dice = random.Random(7)
    values = [358.0, 0.0, 180.0, 352.0, 360.0, 361.0, -1.0, math.nan, None, math.inf, -math.inf]
    values += [dice.uniform(-400, 800) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    found = df.select("a", rules.correct_azimuth(F.col("a"), declination)).collect()
    assert [repr(r[1]) for r in found] == [repr(turned(v, declination)) for v in values]
    valid = [r[1] for r in found if r[0] is not None and 0 <= r[0] <= 360]
    assert all(0 <= v <= 360 for v in valid)


def test_declination_examples(spark):
    cases = [(358.0, 8.0, 6.0), (0.0, -8.0, 352.0), (180.0, 8.0, 188.0), (352.0, 8.0, 360.0)]
    for azimuth, declination, wanted in cases:
        df = spark.range(1).select(rules.correct_azimuth(F.lit(azimuth), declination))
        assert df.first()[0] == wanted


def test_declination_of_text(spark):
    df = spark.createDataFrame([("358",), (" 10.5 ",), ("north",), ("nan",), (None,)], "a string")
    found = [r[0] for r in df.select(rules.correct_azimuth(F.col("a"), 8.0)).collect()]
    assert found[:3] == [6.0, 18.5, None]
    assert math.isnan(found[3]) and found[4] is None


def test_ranges_and_colours(spark):
    values = [None, math.nan, -0.001, 0.0, 30.0, 30.1, 60.0, 60.1, 90.0, 90.001]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    found = df.select(rules.valid_dip(F.col("d")), rules.dip_colour(F.col("d"))).collect()
    assert [r[0] for r in found] == [False, False, False, *[True] * 6, False]
    assert [r[1] for r in found] == ["blue"] * 5 + ["green", "green", "red", "red", "red"]


def test_text_is_no_reading(spark):
    df = spark.createDataFrame([("45",)], "d string")
    assert df.select(rules.column_rule(df, "d", rules.valid_dip)).first()[0] is False


def test_tuple_literals(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\t", "line\n", "\x01é\xa0"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "t string")
    found = [r[0] for r in df.select(text.quoted_literal(F.col("t"))).collect()]
    assert found == [repr(v) for v in [*values, None]]


def test_stems(spark):
    from pathlib import PurePosixPath

    paths = ["a/b/IMG1.jpg", "x.tar.gz", "noext", "a/.hidden", "a.b/c", "dir/.x.jpg", "é 1.JPG"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = df.select(text.stem(F.col("p")), text.base_name(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [(PurePosixPath(p).stem, PurePosixPath(p).name) for p in paths]


def test_stylesheet(spark):
    page = '\n<style>x</style>\n<link rel="stylesheet" a/>\n<link rel="stylesheet" b/>\n<body>$1\\'
    df = spark.createDataFrame([(page,), ("<style>",), ("<p>",), ("stylesheet",)], "h string")
    found = df.select(
        text.stylesheet_status(F.col("h")), text.link_stylesheet(F.col("h"), "s$1.css")
    ).collect()
    assert [r[0] for r in found] == ["ok", "no_stylesheet", "no_style", "ok"]
    lines = page.split("\n")
    lines.insert(4, '    <link rel="stylesheet" href="s$1.css"/>')
    assert found[0][1] == "\n".join(lines)
    assert found[1][1] is None and found[2][1] is None
    assert found[3][1].startswith("stylesheet\n")


def test_styles(spark):
    df = spark.createDataFrame(
        [("Lineament", None), ("Lineament", "red"), ("Bedrock", "red"), (None, "red")],
        "s string, c string",
    )
    found = [r[0] for r in df.select(rules.recolour(rules.style_map(F.col("s")), F.col("c"))).collect()]
    assert found[0] == {"color": "black", "weight": "1"}
    assert found[1] == {"color": "red", "weight": "1"}
    assert found[2] == {"strokeColor": "red", "fillOpacity": "0.0", "weight": "0.5"}
    assert found[3] is None


def test_known_point(spark):
    df = spark.createDataFrame([(60.0, 27.0)], "LAT double, LON double")
    x, y = geo.with_projected(df, 3067).select("x", "y").first()
    assert abs(x - 500000.0) < 1e-6 and abs(y - 6651411.190) < 1e-3


@pytest.mark.parametrize("epsg", [3067, 25834, 32635, 32735, 3857, 4326])
def test_round_trip(spark, epsg):
    south = epsg == 32735
    points = [((-1 if south else 1) * lat / 2, lon / 2) for lat in range(118, 142, 3) for lon in range(40, 64, 3)]
    df = spark.createDataFrame(points, "LAT double, LON double")
    there = geo.with_projected(df, epsg)
    back = there.select("LAT", "LON", geo.unproject(F.col("x"), F.col("y"), epsg).alias("p"))
    for row in back.collect():
        assert abs(row["p"][0] - row["LON"]) < 1e-9 and abs(row["p"][1] - row["LAT"]) < 1e-9


def test_poles_and_unknown_systems(spark):
    df = spark.createDataFrame([(95.0, 27.0), (None, 27.0)], "LAT double, LON double")
    assert [tuple(r) for r in geo.with_projected(df, 3067).select("x", "y").collect()] == [
        (None, None)
    ] * 2
    with pytest.raises(ValueError, match="27700"):
        geo.with_projected(df, 27700)


def test_point_wkb(spark):
    dice = random.Random(3)
    values = [0.0, 1.0, -1.0, 0.1, 2.0, 3.9999999999999996, 6651411.19, -1e-5, 1e15]
    values += [dice.uniform(-8e6, 8e6) for _ in range(500)]
    df = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    found = [bytes(r[0]) for r in df.select(geo.point_wkb(F.col("x"), F.col("y"))).collect()]
    assert found == [b"\x01" + struct.pack("<I", 1) + struct.pack("<dd", v, -v if v else 0.0) for v in values]


def test_envelope_holds_the_box(spark):
    from strataspark.operators.selection import within_bounds

    points = [(i, 58.0 + (i * 37 % 1300) / 100, 18.0 + (i * 53 % 1500) / 100) for i in range(6000)]
    df = spark.createDataFrame(points, "_rid long, LAT double, LON double")
    for bounds in [
        (150000.0, 6700000.0, 500000.0, 7400000.0),
        (500000.0, 7400000.0, 150000.0, 6700000.0),
        (-100000.0, 6400000.0, 1200000.0, 8000000.0),
    ]:
        exact = geo.keep_in_box(geo.with_projected(df, 3067), bounds)
        fast = within_bounds(df, bounds, 3067)
        assert sorted(r[0] for r in fast.select("_rid").collect()) == sorted(
            r[0] for r in exact.select("_rid").collect()
        )


def test_box_edges(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 1.0, 4.0001), (4, None, 3.0), (5, math.nan, 3.0)],
        "i int, x double, y double",
    )
    for bounds in [(1.0, 2.0, 3.0, 4.0), (3.0, 4.0, 1.0, 2.0)]:
        inside = geo.in_box(F.col("x"), F.col("y"), bounds)
        assert [r[0] for r in df.where(inside).orderBy("i").collect()] == [1, 2]
