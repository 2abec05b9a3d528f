"""Literal cases; expected values were worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfolio.functions import dates, parse, vectors

T = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ('<rect x="1" y="2" width="33" height="4"/>', (1, 2, 33, 4)),
        (' <rect x="1" y="2" width="33" height="4"/>\n', (1, 2, 33, 4)),
        ('<rect x="-1" y="2" width="33" height="4"/>', None),
        ('<rect y="2" x="1" width="33" height="4"/>', None),
        ('<rect x="1" y="2" width="33" height="4"/>z', None),
        ("", None),
        (None, None),
    ],
)
def test_rect(spark, xml, want):
    got = one(spark, parse.rect(F.lit(xml).cast("string")))
    assert (tuple(got) if got else None) == want


def test_sides_of_a_rect(spark):
    """Read off a string that is known to be a rectangle; a number beyond 64 bits is NULL."""
    xml = ' <rect x="1" y="99999999999999999999" width="33" height="4"/>\n'
    assert one(spark, parse.is_rect(F.lit(xml))) and not one(spark, parse.is_rect(F.lit(xml + "z")))
    assert tuple(one(spark, parse.sides(F.lit(xml)))) == tuple(one(spark, parse.rect(F.lit(xml)))) == (1, None, 33, 4)


@pytest.mark.parametrize(
    ("path", "want"),
    [("/2009-08-23 new in Germany", dt.date(2009, 8, 23)), ("/Family/2009-08-23", None), ("/2009-02-30", None), ("/0000-01-01", None), ("2009-08-23", None), (None, None)],
)
def test_folder_date(spark, path, want):
    assert one(spark, parse.folder_date(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("2010-10-25 19.08.44.png", T(2010, 10, 25, 19, 8, 44)),
        ("20110219_165529.jpg", T(2011, 2, 19, 16, 55, 29)),
        ("2010-10-25 25.08.44.png", T(2010, 10, 25)),
        ("2010-10-25 19.08.60.png", T(2010, 10, 25)),
        ("20101325_000000.jpg", None),
        ("IMG_1.jpg", None),
        (None, None),
    ],
)
def test_filename_date(spark, name, want):
    assert one(spark, parse.filename_date(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2010-01-01T02:03:04.567", T(2010, 1, 1, 2, 3, 4)),
        ("2010-1-2 3:4:5", T(2010, 1, 2, 3, 4, 5)),
        ("2010-01-02", T(2010, 1, 2)),
        ("2010-01-01 00:00:00Z", None),
        (" 2010-01-01", None),
        ("2010-01-01 00:00:60", None),
        ("", None),
        (None, None),
    ],
)
def test_library_date(spark, raw, want):
    assert one(spark, parse.library_date(F.lit(raw).cast("string"))) == want


def test_exif_date(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, parse.exif_date(s(" 2010:01:02 03:04:05 "))) == T(2010, 1, 2, 3, 4, 5)
    assert one(spark, parse.exif_date(s("2010-01-02 03:04:05"))) == T(2010, 1, 2, 3, 4, 5)
    assert one(spark, parse.exif_date(s("2010:01:02"))) == T(2010, 1, 2)
    # an unparsable tag gives way
    assert one(spark, parse.exif_tags_date(s("0000:00:00 00:00:00"), s(None), s("2011:01:02"))) == T(2011, 1, 2)


def test_floor_days_depend_on_order(spark):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2020-01-01 00:00:00", "2020-03-31 01:00:00"))
    assert one(spark, dates.floor_days(a, b)) == 91
    assert one(spark, dates.floor_days(b, a)) == 90


def test_days(spark):
    assert one(spark, dates.days_since_2000(F.lit(None).cast("timestamp_ntz"))) == 0.0
    assert one(spark, dates.days_since_2000(F.lit("2000-01-02 12:00:00").cast("timestamp_ntz"))) == 1.5
    assert one(spark, dates.days_since_2000(F.lit("1999-12-31").cast("timestamp_ntz"))) == -1.0


def test_crop_box(spark):
    box = lambda *v: one(spark, vectors.crop_box(*(F.lit(x) for x in v)))
    assert tuple(box(10, 10, 20, 20, 100, 100)) == (4, 4, 36, 36)
    assert box(200, 0, 10, 10, 100, 100) is None
    assert box(0, 0, 3, 50, 100, 100) is None


def test_vectors(spark):
    v = F.array(*(F.lit(x).cast("float") for x in (3.0, 4.0)))
    assert one(spark, vectors.l2_normalize(v)) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert abs(one(spark, vectors.fused(F.lit(1.0), F.lit(60.0), F.lit(0.0), 30.0)) - 0.1353) < 1e-4
    import struct

    rows = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0) + b"x"),), (None,)], "b binary")
    assert [r.v for r in rows.select(vectors.from_blob("b").alias("v")).collect()] == [[1.5, -2.0], None]


def test_formats(spark):
    assert one(spark, parse.html_escape(F.lit('a<b & "c">d'))) == "a&lt;b &amp; &quot;c&quot;&gt;d"
    assert one(spark, parse.percent(F.lit(0.125))) == "12%" and one(spark, parse.percent(F.lit(1.0))) == "100%"
    assert one(spark, parse.full_path(F.lit("/"), F.lit("/a/b"), F.lit("c.jpg"))) == "/a/b/c.jpg"
    assert one(spark, parse.full_path(F.lit("/lib/"), F.lit("/"), F.lit("c.jpg"))) == "/lib/c.jpg"
    assert one(spark, parse.tooltip(F.lit(None).cast("string"), F.lit(0.5), F.lit("2010-01-01"))) == "conf 50% | 2010-01-01"
    assert one(spark, parse.thousands(F.lit(1234567))) == "1,234,567"
