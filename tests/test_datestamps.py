import datetime as dt
import random

from kinfolio.operators import datestamps

SCHEMA = "id long, filename string, album_path string, exif_date timestamp_ntz, digikam_date timestamp_ntz, filename_date timestamp_ntz, folder_date date, camera_model string"
T, D = dt.datetime, dt.timedelta


def frame(spark, rows):
    return spark.createDataFrame([(k, f"f{k}", *r) for k, r in enumerate(rows)], SCHEMA)


def flags(spark, *row):
    return datestamps.flagged(frame(spark, [("/a", *row, None)])).first().datestamp_flags


def test_flags(spark):
    assert flags(spark, None, None, None, None) == ["no_date"]
    assert flags(spark, None, T(1970, 1, 1), None, None) == []
    assert flags(spark, T(1970, 1, 1), None, None, dt.date(2007, 3, 10)) == ["epoch_reset:exif=1970-01-01", "disagree:exif↔folder=13582d"]
    assert flags(spark, T(2031, 1, 1), None, None, None) == ["future:exif=2031-01-01"]
    for days, want in ((30, []), (31, ["folder_drift:31d"]), (90, ["folder_drift:90d"]), (91, ["disagree:exif↔folder=91d"])):
        assert flags(spark, T(2010, 1, 1) + D(days=days), None, None, dt.date(2010, 1, 1)) == want
    assert flags(spark, T(2010, 1, 1), T(2010, 1, 1) + D(days=90, hours=1), None, None) == ["disagree:exif↔digikam=91d"]


def test_median_is_the_upper_one(spark):
    clean = [("/a", T(2010, 1, k), None, None, None, "M") for k in (1, 2, 3, 4)]
    rows = [*clean, ("/a", T(1980, 1, 1), None, None, None, "M"), ("/b", T(1980, 1, 1), T(2001, 1, 1), None, None, "M"), ("/a", T(1980, 1, 1), T(2002, 1, 1), None, dt.date(2002, 1, 2), "other"), ("/c", None, None, T(2010, 1, 1), None, None)]
    out = {r.id: r.corrected_date for r in datestamps.annotated(frame(spark, rows)).collect()}
    assert out[4] == T(2010, 1, 3) and out[5] == T(2001, 1, 1)
    assert out[6] == T(2002, 1, 2)  # neighbours of another known model do not count
    assert out[7] is None  # a file name's date is never the corrected one


def plain(rows):
    """The rule spelled out for each pair."""
    found, out = [], []
    for album, e, k, n, f, model in rows:
        fd = T(f.year, f.month, f.day) if f else None
        s = [(a, d) for a, d in (("exif", e), ("digikam", k), ("filename", n), ("folder", fd)) if d]
        bad = not s or bool(e and (e < T(1990, 1, 1) or e > T(2030, 1, 1))) or any(abs((a[1] - b[1]).days) > 90 for i, a in enumerate(s) for b in s[i + 1 :]) or bool(e and fd and 30 < abs((e - fd).days) <= 90)
        found.append(bad)
    for bad, (album, e, k, _n, f, model) in zip(found, rows, strict=True):
        fd = T(f.year, f.month, f.day) if f else None
        near = sorted(r[1] for b, r in zip(found, rows, strict=True) if not b and r[0] == album and r[1] and (not model or not r[5] or r[5] == model))
        out.append((near[len(near) // 2] if near else fd or k) if bad else e or k or fd)
    return out


def test_equals_plain_version(spark):
    rng = random.Random(6)
    day = lambda p: T(2010, 1, 1) + D(days=rng.randint(0, 120), hours=rng.randint(0, 23)) if rng.random() < p else None
    rows = []
    for _ in range(300):
        f = day(0.5)
        rows.append((rng.choice(["/a", "/b", None]), day(0.8), day(0.7), day(0.3), f.date() if f else None, rng.choice(["M", "N", "", None])))
    got = {r.id: r.corrected_date for r in datestamps.annotated(frame(spark, rows)).collect()}
    assert [got[k] for k in range(300)] == plain(rows)


def test_report(spark):
    rows = datestamps.annotated(frame(spark, [("/a", T(1980, 1, 1), None, None, None, None), ("/a", T(2010, 1, 1), None, None, None, None)]))
    assert [(r.flags, r.exif_date, r.folder_date) for r in datestamps.report(rows).collect()] == [("epoch_reset:exif=1980-01-01", "1980-01-01", "—")]
    assert [r.flags for r in datestamps.report(rows, show_clean=True).collect()] == ["epoch_reset:exif=1980-01-01", "clean"]
