"""A small library in SQLite, from its files to the reports."""

import sqlite3
import struct

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from kinfolio.operators import photos, reports
from kinfolio.sources import exif, images, sqlite


def rect(x, y, w, h):
    return f'<rect x="{x}" y="{y}" width="{w}" height="{h}"/>'


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lib") / "library.db")
    c = sqlite3.connect(path)
    c.executescript(
        """
        CREATE TABLE AlbumRoots(specificPath TEXT); CREATE TABLE Albums(id INT, relativePath TEXT);
        CREATE TABLE Images(id INT, name TEXT, fileSize INT, uniqueHash TEXT, album INT, status INT);
        CREATE TABLE ImageInformation(imageid INT, creationDate TEXT, width INT, height INT);
        CREATE TABLE ImageMetadata(imageid INT, make TEXT, model TEXT); CREATE TABLE Tags(id INT, pid INT, name TEXT);
        CREATE TABLE ImageTagProperties(imageid INT, tagid INT, property TEXT, value TEXT);
        CREATE TABLE IdentityAttributes(id INT, attribute TEXT, value TEXT); CREATE TABLE FaceMatrices(identity INT, embedding BLOB);
        CREATE TABLE Thumbnails(id INT, type INT, data BLOB); CREATE TABLE UniqueHashes(uniqueHash TEXT, fileSize INT, thumbId INT);
        """
    )
    many = lambda t, rows: c.executemany(f"INSERT INTO {t} VALUES ({','.join('?' * len(rows[0]))})", rows)
    many("AlbumRoots", [("/photos",), ("/a-second-root",)])
    many("Albums", [(1, "/2010-10-25 trip"), (2, "/misc")])
    many("Images", [(1, "a.jpg", 10, "h1", 1, 1), (2, "20110219_165529.jpg", 20, "h2", 2, 1), (3, "gone.jpg", 30, "h3", 1, 3), (4, "no-album.jpg", 40, "h4", 9, 1), (5, "b.jpg", 0, "h5", 1, 1)])
    many("ImageInformation", [(1, "2010-10-25T02:03:04.567", 100, 80), (2, "bad", 50, 50)])
    many("ImageMetadata", [(1, "Canon", ""), (2, "Nikon", "D1")])
    many("Tags", [(11, 4, "Ann"), (12, 4, "Bob"), (13, 7, "Place")])
    many("ImageTagProperties", [(1, 11, "autodetectedFace", rect(1, 2, 33, 4)), (1, 12, "autodetectedFace", rect(-1, 2, 3, 4)), (1, 12, "autodetectedFace", rect(5, 6, 7, 8)), (2, 13, "autodetectedFace", rect(1, 1, 9, 9)), (2, 11, "tagRegion", rect(1, 1, 1, 1))])
    many("IdentityAttributes", [(1, "name", "ann"), (1, "fullName", "Ann A."), (1, "fullName", "Ann B."), (2, "name", "bob"), (2, "name", "rob"), (3, "uuid", "x")])
    many("FaceMatrices", [(1, struct.pack("<3f", 1, 2, 3)), (9, struct.pack("<3f", 0, 0, 0)), (1, struct.pack("<3f", 4, 5, 6))])
    many("Thumbnails", [(1, 2, b"jpeg1"), (2, 1, b"pgf2")])
    many("UniqueHashes", [("h1", 10, 1), ("h2", 20, 2), ("h5", 0, 1)])
    c.commit()
    c.close()
    return path


@pytest.fixture(scope="module")
def table(spark, library):
    return lambda name: sqlite.read_table(spark, library, name)


@pytest.fixture(scope="module")
def photo_table(table):
    return photos.photos(table("Images"), table("Albums"), table("ImageInformation"), table("ImageMetadata"), photos.album_root(table("AlbumRoots")))


def test_photos(photo_table):
    rows = {r.id: r for r in photo_table.collect()}
    assert set(rows) == {1, 2, 5}
    assert rows[1].full_path == "/photos/2010-10-25 trip/a.jpg" and str(rows[1].folder_date) == "2010-10-25" and str(rows[1].digikam_date) == "2010-10-25 02:03:04"
    assert rows[2].digikam_date is None and str(rows[2].filename_date) == "2011-02-19 16:55:29" and rows[5].width is None
    assert [r.id for r in photos.first_photos(photo_table, 2).collect()] == [1, 5]


def test_faces_count_valid_rectangles(table):
    rows = photos.faces(table("ImageTagProperties"), table("Tags")).collect()
    assert sorted((r.photo_id, r.face_idx, r.x, r.person_name) for r in rows if r.person_name) == [(1, 0, 1, "Ann"), (1, 1, 5, "Bob")]
    assert [(r.photo_id, r.face_idx) for r in rows if not r.person_name] == [(2, 0)]


def test_identities(table):
    rows = {r.id: r for r in photos.identities(table("IdentityAttributes"), table("FaceMatrices")).collect()}
    assert {i: r.name for i, r in rows.items()} == {1: "Ann B.", 2: "bob"}
    assert rows[1].embeddings == [[1, 2, 3], [4, 5, 6]] and rows[2].embeddings == []


def test_images(spark, table, photo_table, tmp_path):
    (tmp_path / "x").mkdir()
    thumbs = photos.thumbnails(table("UniqueHashes"), table("Thumbnails"))
    assert {(r.unique_hash, r.file_size): r.data for r in thumbs.collect()} == {("h1", 10): b"jpeg1", ("h2", 20): None, ("h5", 0): b"jpeg1"}
    files = spark.createDataFrame([("/photos/misc/20110219_165529.jpg", bytearray(b"file"))], "full_path string, content binary")
    faces = photos.faces(table("ImageTagProperties"), table("Tags"))
    codec = images.Codec(lambda b: b, lambda im: (100, 80), lambda im, box: im + repr(box).encode(), lambda im, box, largest, quality: repr((box, largest, quality)).encode())
    made = {(r.photo_id, r.face_idx): r for r in images.crops(faces, photo_table, files, thumbs, codec).collect()}
    assert bytes(made[(1, 1)].crop) == b"jpeg1(3, 4, 14, 16)" and bytes(made[(1, 1)].jpeg) == b"((3, 4, 14, 16), 140, 80)"
    assert bytes(made[(2, 0)].crop).startswith(b"file") and {k[0] for k in made} == {1, 2}


def test_wanted_files_alone_are_opened_once(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k}.img").write_bytes(b"bad" if k == 3 else f"image {k}".encode())
    rows = spark.createDataFrame([(k, str(tmp_path / f"{k}.img"), f"h{k}", 1) for k in range(12)] + [(90, str(tmp_path / "none.img"), "h90", 1), (91, None, "", 0)], "id long, full_path string, unique_hash string, file_size long")
    thumbs = spark.createDataFrame([("h3", 1, bytearray(b"small 3")), ("h90", 1, bytearray(b"small 90"))], "unique_hash string, file_size long, data binary")
    faces = spark.createDataFrame([(k, i, 10, 10, 20, 20) for k in [*range(10), 90, 91] for i in range(3)], "photo_id long, face_idx int, x int, y int, width int, height int")
    opened = spark.sparkContext.accumulator(0)

    def decode(data):
        opened.add(1)
        if data == b"bad":
            raise ValueError
        return data

    made = images.crops(faces, rows, None, thumbs, images.Codec(decode, lambda im: (50, 50), lambda im, box: im)).collect()
    want = {k: f"small {k}" if k in (3, 90) else f"image {k}" for k in [*range(10), 90]}
    assert {(r.photo_id, r.face_idx): bytes(r.crop).decode() for r in made} == {(k, i): v for k, v in want.items() for i in range(3)}
    assert opened.value == 12  # a photo once, and the thumbnail of the bad one


def test_summary(table, photo_table):
    faces = photos.faces(table("ImageTagProperties"), table("Tags"))
    got = {r.metric: r.value for r in reports.database_summary(photo_table, faces, photos.vector_counts(table("IdentityAttributes"), table("FaceMatrices"))).collect()}
    assert got == {"total_photos": 3, "albums": 2, "photos_with_faces": 2, "face_regions": 3, "tagged_regions": 2, "known_identities": 2, "identity_vectors": 2}
    people = reports.top_people(faces.withColumn("photo_ord", F.col("photo_id"))).collect()
    assert [(r.person_name, r.faces) for r in people] == [("Ann", 1), ("Bob", 1)]


def test_sqlite_pushdown_and_missing_file(spark, library, tmp_path):
    rows = sqlite.read_table(spark, library, "Images").where("status = 1 AND id IN (1, 3) AND name IS NOT NULL")
    assert [r.id for r in rows.collect()] == [1]
    with pytest.raises(FileNotFoundError):
        sqlite.connect(str(tmp_path / "none.db"))
    assert not (tmp_path / "none.db").exists()


def exif_jpeg(order="<", original=b"2010:01:02 03:04:05\0", make=b"Canon \0"):
    text = b""
    base = 8 + 2 + 12 * 2 + 4 + 2 + 12 * 1 + 4

    def ascii_entry(tag, value):
        nonlocal text
        entry = struct.pack(order + "HHII", tag, 2, len(value), base + len(text))
        text += value
        return entry

    ifd0 = struct.pack(order + "H", 2) + ascii_entry(0x010F, make) + struct.pack(order + "HHII", 0x8769, 4, 1, 8 + 2 + 24 + 4) + b"\0" * 4
    sub = struct.pack(order + "H", 1) + ascii_entry(0x9003, original) + b"\0" * 4
    block = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + ifd0 + sub + text
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_exif_reads_ranges_of_the_wanted_files(spark, tmp_path):
    data = exif_jpeg()
    padded = data[:2] + b"\xff\xe0" + struct.pack(">H", 50_002) + b"x" * 50_000 + data[2:] + b"\0" * 3_000_000
    (tmp_path / "a b.jpg").write_bytes(padded)
    (tmp_path / "t.tif").write_bytes(data[12:-2] + b"\0" * 2_000_000)
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "empty.jpg").write_bytes(b"")
    names = ["a b.jpg", "t.tif", "x.jpg", "empty.jpg", "none.jpg"]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*names, "t.tif"]] + [(None,)], "full_path string")
    got = {r.full_path.rsplit("/", 1)[1]: (str(r.date), r.make) for r in exif.read_exif(paths).collect()}
    assert got == {n: ("2010-01-02 03:04:05", "Canon") if n in ("a b.jpg", "t.tif") else ("None", None) for n in names}
    for name in ("a b.jpg", "t.tif"):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            ranges = exif.Ranges(f)
            assert exif.tags_of(ranges)[3] == "Canon " and ranges.read < 1000


def test_exif_fills_gaps(spark, photo_table):
    files = spark.createDataFrame([("/photos/2010-10-25 trip/a.jpg", bytearray(exif_jpeg())), ("/photos/misc/20110219_165529.jpg", bytearray(exif_jpeg(">", b"2012:01:02 03:04:05\0"))), ("/x", bytearray(b"\xff\xd8broken")), ("/y", None)], "path string, content binary")
    tags = {r.full_path: r for r in exif.from_files(files).collect()}
    assert str(tags["/photos/2010-10-25 trip/a.jpg"].date) == "2010-01-02 03:04:05" and tags["/photos/2010-10-25 trip/a.jpg"].make == "Canon"
    assert tags["/x"].date is None and tags["/y"].date is None
    rows = {r.id: r for r in photos.fill_exif(photo_table, exif.from_files(files)).collect()}
    assert str(rows[2].exif_date) == "2012-01-02 03:04:05" and rows[2].camera_make == "Nikon" and rows[5].exif_date is None
