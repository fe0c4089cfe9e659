"""Families of projections against published points, round trips and envelopes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataspark.functions import geo
from strataspark.functions import projections as pr
from strataspark.operators.layers import to_geographic
from strataspark.operators.selection import within_bounds

CLARKE_FEET = (20925832.16, 1 / (1 - math.sqrt(1 - 0.08227185**2)))

# Worked examples of IOGP 373-7-2: projection, longitude, latitude, easting, northing.
PUBLISHED = [
    (
        pr.LambertConic(
            (-99.0, 27 + 50 / 60), (28 + 23 / 60, 30 + 17 / 60), 2000000.0, 0.0, CLARKE_FEET
        ),
        -96.0, 28.5, 2963503.91, 254759.80,
    ),
    (pr.PROJECTIONS[3035], 5.0, 50.0, 3962799.45, 2999718.85),
    (pr.PROJECTIONS[5041], 44.0, 73.0, 3320416.75, 632668.43),
    (pr.PROJECTIONS[3032], 120.0, -75.0, 7255380.79, 7053389.56),
]


@pytest.mark.parametrize("case", PUBLISHED, ids=lambda c: type(c[0]).__name__)
def test_published_points(case):
    projection, lon, lat, x, y = case
    found = pr.on_numbers(projection.forward(), lon=lon, lat=lat)
    assert abs(found.x - x) < 0.01 and abs(found.y - y) < 0.01
    back = pr.on_numbers(projection.inverse(), x=x, y=y)
    assert abs(back.lon - lon) < 2e-7 and abs(back.lat - lat) < 2e-7


def test_published_datum_shift():
    shift = pr.Helmert((0.0, 0.0, 4.5), (0.0, 0.0, 0.554), 0.219, pr.WGS84)
    found = shift.geocentric_to_wgs84(3657660.66, 255768.55, 5201382.11)
    wanted = (3657660.78, 255778.43, 5201387.75)
    assert all(abs(a - b) < 0.01 for a, b in zip(found, wanted, strict=True))


AREAS = {2154: (-4, 42, 8, 51), 3034: (-30, 30, 40, 70), 3301: (21, 57, 28, 60), 3035: (-30, 30, 40, 70)}


def _area(code):
    if code in AREAS:
        return AREAS[code]
    projection = pr.PROJECTIONS.get(code)
    if projection is None:
        middle = geo.transverse_mercator(code).central_meridian
        return middle - 3, 58, middle + 3, 70
    north = getattr(projection, "north", True) and getattr(projection, "origin", (0, 90))[1] > 0
    return (-180, 55, 180, 89.5) if north else (-180, -89.5, 180, -55)


CODES = sorted(pr.PROJECTIONS) + [3006, 3873, 3879, 3885, *geo.KKJ_ZONES]


def test_round_trips_of_all_codes(spark):
    draw = random.Random(4)
    for code in CODES:
        west, south, east, north = _area(code)
        points = [(draw.uniform(west, east), draw.uniform(south, north)) for _ in range(40)]
        df = spark.createDataFrame(points, "LON double, LAT double")
        placed = geo.with_projected(df, code)
        assert placed.columns == ["LON", "LAT", "x", "y"]
        back = placed.withColumn("p", geo.unproject(F.col("x"), F.col("y"), code)).collect()
        for row in back:
            turned = (row.p[0] - row.LON + 180) % 360 - 180
            # Shifts of datum are undone to the precision of their approximate inverse.
            near = 2e-7 if geo.datum_shift(code) else 1e-10
            assert abs(turned) * math.cos(math.radians(row.LAT)) < near, (code, row)
            assert abs(row.p[1] - row.LAT) < near, (code, row)
            if code in pr.PROJECTIONS:
                own = pr.on_numbers(pr.PROJECTIONS[code].forward(), lon=row.LON, lat=row.LAT)
                assert abs(own.x - row.x) < 1e-6 and abs(own.y - row.y) < 1e-6


def test_poles_origins_and_missing_latitudes(spark):
    df = spark.createDataFrame(
        [(10.0, 90.0), (10.0, 52.0), (10.0, -90.0), (10.0, 91.0), (10.0, None), (None, 52.0)],
        "LON double, LAT double",
    )

    def at(code):
        return [(r.x, r.y) for r in geo.with_projected(df, code).select("x", "y").collect()]

    assert [x is None for x, _ in at(5041)] == [False, False, True, True, True, True]
    assert at(5041)[0] == (2000000.0, 2000000.0)
    assert at(3035)[1] == pytest.approx((4321000.0, 3210000.0))
    assert at(3034)[1] == pytest.approx((4000000.0, 2800000.0))
    assert at(3034)[0][0] == pytest.approx(4000000.0) and at(3034)[2] == (None, None)
    assert at(3035)[0][0] == pytest.approx(4321000.0) and at(3035)[4] == (None, None)
    back = spark.range(1).select(geo.unproject(F.lit(4321000.0), F.lit(3210000.0), 3035).alias("p"))
    assert back.first().p == pytest.approx([10.0, 52.0])


def test_zones_of_one_degree():
    # Every zone is the same map under another meridian and number.
    for code in range(3873, 3886):
        tm = geo.transverse_mercator(code)
        assert (tm.central_meridian, tm.scale) == (code - 3854, 1.0)
        assert tm.false_easting == (code - 3854) * 1e6 + 500000


def test_national_system_lies_where_it_should(spark):
    """The old national grid lies some hundred metres off; its own meridian keeps its easting."""
    df = spark.createDataFrame([(27.0, 62.0)], "LON double, LAT double")
    old = geo.with_projected(df, 2393).first()
    new = geo.with_projected(df, 3067).first()
    assert abs(old.x - 3500000 - (new.x - 500000) / 0.9996 - 183) < 30
    assert 0 < abs(old.y - new.y / 0.9996) < 400


@pytest.mark.parametrize("code", [3034, 3035, 3301, 3413, 3032, 3879, 2393, 6931, 3575])
def test_envelope_changes_nothing(spark, code):
    west, south, east, north = _area(code)
    draw = random.Random(code)
    points = [(i, draw.uniform(west, east), draw.uniform(south, north)) for i in range(600)]
    df = spark.createDataFrame(points, "id int, LON double, LAT double").cache()
    placed = [(r.x, r.y) for r in geo.with_projected(df, code).collect()]
    for _ in range(4):
        (x0, y0), (x1, y1) = draw.sample(placed, 2)
        box = (x0, y0, x1, y1)
        found = {r.id for r in within_bounds(df, box, code).collect()}
        exact = {r.id for r in geo.keep_in_box(geo.with_projected(df, code), box).collect()}
        assert found == exact and len(found) >= 2
    df.unpersist()


def test_box_around_a_pole_has_no_envelope():
    assert geo.geographic_envelope((-1000.0, -1000.0, 1000.0, 1000.0), 3413) is None
    assert geo.geographic_envelope((1e6, 1e6, 1.2e6, 1.2e6), 3413) is not None


def test_layers_of_any_system(spark):
    rows = [("a", 3035, "Point", 4321000.0, 3210000.0), ("b", 2393, "Point", 3500000.0, 6875000.0)]
    features = spark.createDataFrame(rows, "dataset string, epsg int, geometry_type string, x double, y double")
    features = features.withColumn("vertices", F.array(F.array(F.array(F.array("x", "y"))))).drop("x", "y")
    found = {r.dataset: r.vertices[0][0][0] for r in to_geographic(features).collect()}
    assert found["a"] == pytest.approx([10.0, 52.0])
    assert found["b"] == pytest.approx([27.0, 62.0], abs=0.03)


def test_unknown_code_names_what_is_known():
    with pytest.raises(ValueError, match="3035"):
        geo.check_epsg(9999)
