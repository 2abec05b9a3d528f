"""Every operator on the benchmark's tables, with the same question in DuckDB SQL.

The tables hold no photos, so orders stand for photos (customers for albums, priorities for cameras, ship dates for EXIF and
file-name dates), line items for faces, parts and suppliers for people, and the vectors' labels for identities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, parse, vectors
from ..operators import assign, clustering, datestamps, gallery, hdbscan, naming, photos, reports, similarity
from ..storage import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: No date of the tables precedes 1990, so the early bound is raised until flags fire.
LIMITS = datestamps.Limits(earliest="1999-01-01")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


# photos


def photo_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    ships = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("exif_date"), F.max("l_shipdate").alias("filename_date"))
    return orders.join(ships, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"), F.concat(F.lit("/album-"), (F.col("o_custkey") % 50).cast("string")).alias("album_path"),
        "exif_date", F.col("o_orderdate").alias("digikam_date"), "filename_date", F.trunc("o_orderdate", "month").alias("folder_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("camera_model"),
    )


PHOTOS = """
li AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1),
photos AS (
  SELECT o_orderkey AS id, 'P' || o_orderkey || '.jpg' AS filename, '/album-' || (o_custkey % 50) AS album_path, a AS exif_date, CAST(o_orderdate AS TIMESTAMP) AS digikam_date, b AS filename_date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS folder_date, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS camera_model
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)"""


def days_sql(a: str, b: str) -> str:
    return f"CAST(abs(floor(date_diff('microsecond', {b}, {a}) / 86400000000.0)) AS BIGINT)"


_D = {"exif": "exif_date", "digikam": "digikam_date", "filename": "filename_date", "folder": "CAST(folder_date AS TIMESTAMP)"}
_PAIRS = [(a, b) for k, a in enumerate(_D) for b in list(_D)[k + 1 :]]
FLAGS = (
    PHOTOS
    + """,
flagged AS (
  SELECT *, CASE WHEN exif_date IS NULL AND digikam_date IS NULL AND filename_date IS NULL AND folder_date IS NULL THEN 'no_date' ELSE concat_ws('; ',
    CASE WHEN exif_date < TIMESTAMP '1999-01-01' THEN 'epoch_reset:exif=' || strftime(exif_date, '%Y-%m-%d') WHEN exif_date > TIMESTAMP '2030-01-01' THEN 'future:exif=' || strftime(exif_date, '%Y-%m-%d') END,
    """
    + ",\n    ".join(f"CASE WHEN {days_sql(_D[a], _D[b])} > 90 THEN 'disagree:{a}↔{b}=' || {days_sql(_D[a], _D[b])} || 'd' END" for a, b in _PAIRS)
    + f""",
    CASE WHEN {days_sql(_D["exif"], _D["folder"])} BETWEEN 31 AND 90 THEN 'folder_drift:' || {days_sql(_D["exif"], _D["folder"])} || 'd' END) END AS flags
  FROM photos)"""
)
CORRECTED = (
    FLAGS
    + """,
fixed AS (
  SELECT p.*, CASE WHEN flags = '' THEN coalesce(exif_date, digikam_date, CAST(folder_date AS TIMESTAMP)) ELSE coalesce(m.median, CAST(folder_date AS TIMESTAMP), digikam_date) END AS corrected_date
  FROM flagged p LEFT JOIN (
    SELECT id, list_sort(list(d))[len(list(d)) // 2 + 1] AS median FROM (
      SELECT p.id, n.exif_date AS d FROM flagged p JOIN flagged n ON p.album_path = n.album_path AND p.id <> n.id AND n.flags = '' AND n.exif_date IS NOT NULL
        AND (coalesce(p.camera_model, '') = '' OR coalesce(n.camera_model, '') = '' OR p.camera_model = n.camera_model)
      WHERE p.flags <> '') GROUP BY id) m ON m.id = p.id)"""
)


@query(
    """
SELECT o_orderkey AS id, 'P' || o_orderkey || '.jpg' AS filename, '/' || c_mktsegment AS album_path, '/lib/' || c_mktsegment || '/P' || o_orderkey || '.jpg' AS full_path, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS digikam_date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS camera_make
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"""
)
def photo_listing(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = tables(spark, sf, "orders", "customer")
    key = F.col("o_orderkey")
    images = orders.select(key.alias("id"), F.concat(F.lit("P"), key.cast("string"), F.lit(".jpg")).alias("name"), F.floor("o_totalprice").cast("long").alias("fileSize"), F.lit("").alias("uniqueHash"), F.col("o_custkey").alias("album"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(3).alias("status"))
    albums = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("/"), "c_mktsegment").alias("relativePath"))
    information = orders.where(key % 5 != 0).select(key.alias("imageid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("creationDate"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    metadata = orders.where(key % 3 != 0).select(key.alias("imageid"), F.col("o_orderpriority").alias("make"), F.lit(None).cast("string").alias("model"))
    rows = photos.photos(images, albums, information, metadata, F.lit("/lib"))
    return rows.select("id", "filename", "album_path", "full_path", "file_size", "digikam_date", "camera_make")


@query(
    """
SELECT o_orderkey AS id, '/' || c_mktsegment AS album_path FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY '/' || c_mktsegment, 'P' || o_orderkey || '.jpg', o_orderkey LIMIT 500"""
)
def photo_prefix(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = tables(spark, sf, "orders", "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"), F.concat(F.lit("/"), "c_mktsegment").alias("album_path"))
    return photos.first_photos(rows, 500).select("id", "album_path")


_ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def properties(lineitem: DataFrame) -> DataFrame:
    """A face rectangle per line item: some of another property, some with parts out of order or negative."""
    bad = F.col("l_linenumber") % 4 == 3
    rect = F.concat(F.lit('<rect x="'), F.when(bad, F.lit("-1")).otherwise(F.col("l_linenumber").cast("string")), F.lit('" y="'), F.col("l_quantity").cast("long").cast("string"), F.lit('" width="'), (F.col("l_partkey") % 90 + 1).cast("string"), F.lit('" height="'), (F.col("l_suppkey") % 70 + 1).cast("string"), F.lit('"/>'))
    return lineitem.select(F.struct(*_ITEM.split(", ")).alias("rowid"), F.col("l_orderkey").alias("imageid"), F.col("l_partkey").alias("tagid"), F.when(F.col("l_returnflag") == "R", F.lit("tagRegion")).otherwise(F.lit(photos.FACE)).alias("property"), rect.alias("value"))


FACES = f"""
pr AS (SELECT *, '<rect x="' || CASE WHEN l_linenumber % 4 = 3 THEN '-1' ELSE CAST(l_linenumber AS VARCHAR) END || '" y="' || CAST(floor(l_quantity) AS BIGINT) || '" width="' || (l_partkey % 90 + 1) || '" height="' || (l_suppkey % 70 + 1) || '"/>' AS v FROM lineitem WHERE l_returnflag <> 'R'),
faces AS (
  SELECT l_orderkey AS photo_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) - 1 AS face_idx,
    CAST(regexp_extract(v, 'x="(\\d+)"', 1) AS BIGINT) AS x, CAST(regexp_extract(v, 'y="(\\d+)"', 1) AS BIGINT) AS y, CAST(regexp_extract(v, 'width="(\\d+)"', 1) AS BIGINT) AS width, CAST(regexp_extract(v, 'height="(\\d+)"', 1) AS BIGINT) AS height,
    CASE WHEN p_size % 2 = 0 THEN p_name END AS person_name
  FROM pr LEFT JOIN part ON p_partkey = l_partkey WHERE regexp_full_match(v, '\\s*<rect x="\\d+" y="\\d+" width="\\d+" height="\\d+"/>\\s*'))"""


def face_rows(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, part = tables(spark, sf, "lineitem", "part")
    tags = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, photos.PEOPLE).otherwise(9).alias("pid"), F.col("p_name").alias("name"))
    return photos.faces(properties(lineitem), tags)


@query(f"WITH {FACES} SELECT photo_id, CAST(face_idx AS INT) AS face_idx, x, y, width, height, person_name FROM faces")
def people_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return face_rows(spark, sf)


@query(f"SELECT l_orderkey AS photo_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) - 1 AS INT) AS face_idx, l_partkey FROM lineitem")
def face_index(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    (lineitem,) = tables(spark, sf, "lineitem")
    return lineitem.select(F.col("l_orderkey").alias("photo_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM.split(", "))) - 1).alias("face_idx"), "l_partkey")


@query(f"WITH {FACES} SELECT photo_id, count(*) AS n_faces, string_agg(face_idx || ':' || coalesce(person_name, '—'), ',' ORDER BY face_idx) AS faces FROM faces GROUP BY photo_id")
def nested_faces(spark: SparkSession, sf: str) -> DataFrame:
    rows = face_rows(spark, sf)
    arrays = photos.nested(rows.select(F.col("photo_id").alias("id")).distinct(), rows)
    shown = F.array_join(F.transform("faces", lambda f: F.concat(f["face_idx"].cast("string"), F.lit(":"), F.coalesce(f["person_name"], F.lit("—")))), ",")
    return arrays.select(F.col("id").alias("photo_id"), F.size("faces").cast("long").alias("n_faces"), shown.alias("faces"))


@query(
    r"""
WITH s AS (SELECT *, CASE WHEN l_linenumber % 4 = 1 THEN ' <rect x="' || l_linenumber || '" y="2" width="33" height="4"/> ' WHEN l_linenumber % 4 = 2 THEN '<rect x="-1" y="2" width="33" height="4"/>'
  WHEN l_linenumber % 4 = 3 THEN '<rect y="2" x="1" width="33" height="4"/>' ELSE '<rect x="' || l_partkey || '" y="' || l_suppkey || '" width="5" height="6"/>' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_full_match(v, '\s*<rect x="(\d+)" y="(\d+)" width="(\d+)" height="(\d+)"/>\s*')
  THEN regexp_extract(v, 'x="(\d+)"', 1) || ',' || regexp_extract(v, 'y="(\d+)"', 1) || ',' || regexp_extract(v, 'width="(\d+)"', 1) || ',' || regexp_extract(v, 'height="(\d+)"', 1) END AS rect FROM s"""
)
def rect_parse(spark: SparkSession, sf: str) -> DataFrame:
    (lineitem,) = tables(spark, sf, "lineitem")
    n, text = F.col("l_linenumber"), lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    v = F.when(n % 4 == 1, text(' <rect x="', n, '" y="2" width="33" height="4"/> ')).when(n % 4 == 2, F.lit('<rect x="-1" y="2" width="33" height="4"/>'))
    v = v.when(n % 4 == 3, F.lit('<rect y="2" x="1" width="33" height="4"/>')).otherwise(text('<rect x="', F.col("l_partkey"), '" y="', F.col("l_suppkey"), '" width="5" height="6"/>'))
    r = parse.rect(v)
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(",", r["x"], r["y"], r["width"], r["height"]).alias("s"), r.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("r").isNotNull(), F.col("s")).alias("rect"))


# dates


@query(
    """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/' || strftime(o_orderdate, '%Y-%m-%d') || ' trip' WHEN 1 THEN '/Family/' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '/' || strftime(o_orderdate, '%Y') || '-02-30' ELSE '/' || strftime(o_orderdate, '%Y-%m-%d') END AS p FROM orders)
SELECT o_orderkey, CAST(try_strptime(nullif(regexp_extract(p, '^/(\\d{4}-\\d{2}-\\d{2})', 1), ''), '%Y-%m-%d') AS DATE) AS folder_date FROM s"""
)
def folder_date(spark: SparkSession, sf: str) -> DataFrame:
    (orders,) = tables(spark, sf, "orders")
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    path = F.when(kind == 0, F.concat(F.lit("/"), day, F.lit(" trip"))).when(kind == 1, F.concat(F.lit("/Family/"), day)).when(kind == 2, F.concat(F.lit("/"), F.date_format("o_orderdate", "yyyy"), F.lit("-02-30"))).otherwise(F.concat(F.lit("/"), day))
    return orders.select("o_orderkey", parse.folder_date(path).alias("folder_date"))


@query(
    r"""
WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') || '.png' WHEN 1 THEN strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' WHEN 2 THEN 'IMG ' || strftime(ts, '%Y-%m-%d') || '.jpg'
    WHEN 3 THEN strftime(ts, '%Y-%m-%d') || ' 25.08.44.png' WHEN 4 THEN strftime(ts, '%Y') || '1325_000000.jpg' ELSE 'IMG_' || event_id || '.jpg' END AS n FROM events),
e AS (SELECT event_id, regexp_extract(n, '(\d{4})-(\d{2})-(\d{2})[ _T](\d{2})[.:](\d{2})[.:](\d{2})') AS a, regexp_extract(n, '(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})') AS b, regexp_extract(n, '(\d{4})-(\d{2})-(\d{2})') AS c FROM s)
SELECT event_id, coalesce(try_strptime(nullif(regexp_replace(a, '[^0-9]', '', 'g'), ''), '%Y%m%d%H%M%S'), try_strptime(nullif(regexp_replace(b, '_', '', 'g'), ''), '%Y%m%d%H%M%S'), try_strptime(nullif(c, ''), '%Y-%m-%d')) AS filename_date FROM e"""
)
def filename_date(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    kind, f = F.col("event_id") % 6, lambda p: F.date_format("ts", p)
    name = F.when(kind == 0, F.concat(f("yyyy-MM-dd HH.mm.ss"), F.lit(".png"))).when(kind == 1, F.concat(f("yyyyMMdd_HHmmss"), F.lit(".jpg"))).when(kind == 2, F.concat(F.lit("IMG "), f("yyyy-MM-dd"), F.lit(".jpg")))
    name = name.when(kind == 3, F.concat(f("yyyy-MM-dd"), F.lit(" 25.08.44.png"))).when(kind == 4, F.concat(f("yyyy"), F.lit("1325_000000.jpg"))).otherwise(F.concat(F.lit("IMG_"), F.col("event_id").cast("string"), F.lit(".jpg")))
    return events.select("event_id", parse.filename_date(name).alias("filename_date"))


@query(
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN NULL ELSE NULL END AS digikam_date FROM events"""
)
def db_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    kind, f = F.col("event_id") % 5, lambda p: F.date_format("ts", p)
    raw = F.when(kind == 0, f("yyyy-MM-dd'T'HH:mm:ss.SSS")).when(kind == 1, f("yyyy-MM-dd")).when(kind == 2, f("yyyy-M-d H:m:s")).when(kind == 3, F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit("Z"))).otherwise(F.lit(""))
    return events.select("event_id", parse.library_date(raw).alias("digikam_date"))


@query(
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('day', ts) ELSE NULL END AS exif_date FROM events"""
)
def exif_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    kind, f = F.col("event_id") % 5, lambda p: F.date_format("ts", p)
    original = F.when(kind == 0, F.concat(F.lit(" "), f("yyyy:MM:dd HH:mm:ss"), F.lit(" "))).when(kind == 3, F.lit("0000:00:00 00:00:00")).otherwise(F.lit(None))
    digitized = F.when(kind == 1, f("yyyy-MM-dd HH:mm:ss")).when(kind == 4, F.lit("unknown"))
    image = F.when(kind.isin(2, 3), f("yyyy:MM:dd")).when(kind == 0, F.lit("1970:01:01"))
    return events.select("event_id", parse.exif_tags_date(original, digitized, image).alias("exif_date"))


@query(
    f"""WITH {PHOTOS} SELECT id, concat_ws(',', CASE WHEN exif_date IS NOT NULL THEN 'exif=' || strftime(exif_date, '%Y-%m-%d') END, CASE WHEN digikam_date IS NOT NULL THEN 'digikam=' || strftime(digikam_date, '%Y-%m-%d') END,
  CASE WHEN filename_date IS NOT NULL THEN 'filename=' || strftime(filename_date, '%Y-%m-%d') END, CASE WHEN folder_date IS NOT NULL THEN 'folder=' || strftime(folder_date, '%Y-%m-%d') END) AS available FROM photos"""
)
def available_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = datestamps.available(photo_rows(spark, sf))
    shown = F.transform("available", lambda a: F.concat(a["source"], F.lit("="), F.date_format(a["date"], "yyyy-MM-dd")))
    return rows.select("id", F.array_join(shown, ",").alias("available"))


@query(f"WITH {FLAGS} SELECT id, flags FROM flagged")
def anomaly_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = datestamps.flagged(photo_rows(spark, sf), LIMITS)
    return rows.select("id", F.array_join("datestamp_flags", "; ").alias("flags"))


@query(f"WITH {CORRECTED} SELECT id, flags, corrected_date FROM fixed")
def corrected_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = datestamps.annotated(photo_rows(spark, sf), LIMITS)
    return rows.select("id", F.array_join("datestamp_flags", "; ").alias("flags"), "corrected_date")


@query(
    f"""WITH {CORRECTED} SELECT id, filename, album_path, coalesce(strftime(exif_date, '%Y-%m-%d'), '—') AS exif_date, coalesce(strftime(folder_date, '%Y-%m-%d'), '—') AS folder_date, flags, coalesce(strftime(corrected_date, '%Y-%m-%d'), '—') AS corrected_date
FROM fixed WHERE flags <> '' ORDER BY album_path, filename, id LIMIT 100"""
)
def anomaly_report_top100(spark: SparkSession, sf: str) -> DataFrame:
    return datestamps.report(datestamps.annotated(photo_rows(spark, sf), LIMITS))


@query(f"WITH {FLAGS} SELECT count(*) AS photos, count(*) FILTER (WHERE flags <> '') AS flagged FROM flagged")
def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = datestamps.flagged(photo_rows(spark, sf), LIMITS)
    return rows.agg(F.count("*").alias("photos"), F.count_if(F.size("datestamp_flags") > 0).alias("flagged"))


@query(f"SELECT a.event_id AS a, b.event_id AS b, {days_sql('a.ts', 'b.ts')} AS days FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id")
def floor_days_pairs(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    a, b = events.alias("a"), events.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_id") < F.col("b.event_id")))
    return pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), dates.floor_days(F.col("a.ts"), F.col("b.ts")).alias("days"))


@query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE date_diff('microsecond', TIMESTAMP '2000-01-01', ts) / 86400000000.0 END, 6) AS days FROM events")
def date_to_days(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    return events.select("event_id", F.round(dates.days_since_2000(F.when(F.col("event_id") % 4 != 0, F.col("ts"))), 6).alias("days"))


# reports


@query(
    f"""WITH {FACES}, p AS (SELECT o_orderkey AS id, '/album-' || (o_custkey % 50) AS album FROM orders)
SELECT 'total_photos' AS metric, count(*) AS value FROM p UNION ALL SELECT 'albums', count(DISTINCT album) FROM p
UNION ALL SELECT 'photos_with_faces', count(DISTINCT photo_id) FROM faces UNION ALL SELECT 'face_regions', count(*) FROM faces
UNION ALL SELECT 'tagged_regions', count(*) FROM faces WHERE coalesce(person_name, '') <> ''
UNION ALL SELECT 'known_identities', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'identity_vectors', count(*) FROM embeddings"""
)
def db_summary(spark: SparkSession, sf: str) -> DataFrame:
    (embeddings,) = tables(spark, sf, "embeddings")
    identities = embeddings.groupBy(F.col("label").alias("id")).agg(F.count("vec_id").alias("vectors"))
    return reports.database_summary(photo_rows(spark, sf), face_rows(spark, sf), identities)


@query(
    f"""WITH n AS (SELECT l_orderkey, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) - 1 AS i FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 <> 0)
SELECT s_name AS person_name, count(*) AS faces FROM n WHERE s_name IS NOT NULL GROUP BY s_name ORDER BY count(*) DESC, min((l_orderkey, i)) LIMIT 10"""
)
def top10_people(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    lineitem, supplier = tables(spark, sf, "lineitem", "supplier")
    named = supplier.where(F.col("s_suppkey") % 3 != 0).select("s_suppkey", F.col("s_name").alias("person_name"))
    rows = lineitem.withColumn("face_idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM.split(", "))) - 1)
    rows = rows.join(named, rows.l_suppkey == named.s_suppkey, "left").select(F.col("l_orderkey").alias("photo_ord"), "face_idx", "person_name")
    return reports.top_people(rows)


@query(
    """WITH a AS (SELECT c_nationkey AS id, c_custkey AS rowid, c_name AS value, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 2 = 0 THEN 'fullName' WHEN c_custkey % 4 < 3 THEN 'name' ELSE 'uuid' END AS attribute FROM customer)
SELECT id, coalesce(arg_max(value, rowid) FILTER (WHERE attribute = 'fullName'), arg_min(value, rowid) FILTER (WHERE attribute = 'name')) AS name FROM a WHERE attribute IN ('fullName', 'name') GROUP BY id"""
)
def identity_name(spark: SparkSession, sf: str) -> DataFrame:
    (customer,) = tables(spark, sf, "customer")
    kind = F.when((F.col("c_custkey") % 4 == 0) & (F.col("c_nationkey") % 2 == 0), "fullName").when(F.col("c_custkey") % 4 < 3, "name").otherwise("uuid")
    return photos.identity_names(customer.select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("rowid"), F.col("c_name").alias("value"), kind.alias("attribute")))


@query(
    """WITH r AS (SELECT p_brand AS unique_hash, CAST(p_size AS BIGINT) AS file_size, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS type, p_name FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY unique_hash, file_size ORDER BY p_partkey) AS k FROM r)
SELECT unique_hash, file_size, CASE WHEN type = 2 THEN p_name END AS data FROM f WHERE k = 1"""
)
def thumbnail_lookup(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = tables(spark, sf, "part")
    hashes = part.select(F.col("p_brand").alias("uniqueHash"), F.col("p_size").cast("long").alias("fileSize"), F.col("p_partkey").alias("thumbId"))
    thumbs = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(2).alias("type"), F.col("p_name").cast("binary").alias("data"))
    return photos.thumbnails(hashes, thumbs).withColumn("data", F.col("data").cast("string"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x1 - x0 >= 4 AND y1 - y0 >= 4 THEN x0 || ',' || y0 || ',' || x1 || ',' || y1 END AS box FROM (
  SELECT *, greatest(0, x - px) AS x0, greatest(0, y - py) AS y0, least(120, x + w + px) AS x1, least(100, y + h + py) AS y1 FROM (
    SELECT *, CAST(floor(w * 0.3) AS BIGINT) AS px, CAST(floor(h * 0.3) AS BIGINT) AS py FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 200 AS x, l_suppkey % 120 AS y, CAST(l_quantity AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS h FROM lineitem)))"""
)
def crop_box(spark: SparkSession, sf: str) -> DataFrame:
    (lineitem,) = tables(spark, sf, "lineitem")
    b = vectors.crop_box(F.col("l_partkey") % 200, F.col("l_suppkey") % 120, F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.lit(120), F.lit(100))
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", b.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("b").isNotNull(), F.concat_ws(",", "b.x0", "b.y0", "b.x1", "b.y1")).alias("box"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(coalesce(text, '') || '<a href="x">&amp;', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM documents""")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    (documents,) = tables(spark, sf, "documents")
    return documents.select("doc_id", F.md5(parse.html_escape(F.concat(F.coalesce("text", F.lit("")), F.lit('<a href="x">&amp;')))).alias("escaped_md5"))


@query(
    """SELECT o_orderkey AS id, concat_ws(' | ', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, 'conf ' || CAST(round_even((o_orderkey % 101) / 100.0 * 100, 0) AS BIGINT) || '%', CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS tooltip FROM orders"""
)
def gallery_tooltip(spark: SparkSession, sf: str) -> DataFrame:
    (orders,) = tables(spark, sf, "orders")
    k = F.col("o_orderkey")
    date = parse.display_date(F.when(k % 5 != 0, F.col("o_orderdate")), F.lit(None).cast("date"))
    return orders.select(k.alias("id"), parse.tooltip(F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise(F.lit("")), (k % 101) / 100.0, date).alias("tooltip"))


@query("SELECT n_nationkey, format('{:,}', count(*) * 1000) AS faces, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '—' END AS name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def display_formats(spark: SparkSession, sf: str) -> DataFrame:
    nation, customer = tables(spark, sf, "nation", "customer")
    rows = nation.join(customer, nation.n_nationkey == customer.c_nationkey).groupBy("n_nationkey", "n_name").agg((F.count("*") * 1000).alias("n"))
    return rows.select("n_nationkey", parse.thousands(F.col("n")).alias("faces"), parse.or_dash(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("name"))


# vectors


def vec_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as faces: photo vec_id div 3, face vec_id mod 3, with label and days."""
    embeddings, events = tables(spark, sf, "embeddings", "events")
    rows = embeddings.join(events.select(F.col("event_id").alias("vec_id"), "ts"), "vec_id", "left")
    return rows.select("vec_id", F.floor(F.col("vec_id") / 3).cast("long").alias("photo_id"), (F.col("vec_id") % 3).cast("int").alias("face_idx"), "embedding", F.col("label").cast("long").alias("label"), dates.days_since_2000(F.col("ts")).alias("days"))


UNIT = """
e AS (SELECT vec_id, vec_id // 3 AS photo_id, CAST(vec_id % 3 AS INT) AS face_idx, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN ts IS NULL THEN 0.0 ELSE date_diff('microsecond', TIMESTAMP '2000-01-01', ts) / 86400000000.0 END AS days
  FROM embeddings LEFT JOIN events ON event_id = vec_id),
u AS (SELECT *, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS n FROM e)"""


def mean_sql(source: str, key: str) -> str:
    return f"SELECT {key}, list(x ORDER BY i) AS m FROM (SELECT {key}, i, avg(v[i]) AS x FROM (SELECT {key}, v, unnest(range(1, len(v) + 1)) AS i FROM {source}) GROUP BY {key}, i) GROUP BY {key}"


CENTROIDS = (
    UNIT
    + f""",
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e) WHERE r <= 20),
m AS ({mean_sql("k", "label")}),
c AS (SELECT label, list_transform(m, lambda x: x / greatest(sqrt(list_sum(list_transform(m, lambda y: y * y))), 1e-12)) AS c FROM m),
s AS (SELECT vec_id, photo_id, face_idx, u.label, days, c.label AS other, list_sum(list_transform(range(1, len(n) + 1), lambda i: n[i] * c[i])) AS sim FROM u CROSS JOIN c),
b AS (SELECT vec_id, photo_id, face_idx, label, days, arg_max(other, sim) AS best, max(sim) AS sim FROM s GROUP BY ALL)"""
)


def joined(v: str, places: int = 6) -> str:
    """A vector as text; small negative values may not show as -0."""
    return f"array_to_string(list_transform({v}, lambda x: printf('%.{places}f', round(x, {places}) + 0.0)), ',')"


def shown(v: Column, places: int = 6) -> Column:
    return F.array_join(F.transform(v, lambda x: F.format_string(f"%.{places}f", F.round(x, places) + F.lit(0.0))), ",")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    faces = vec_faces(spark, sf)
    return similarity.identity_centroids(faces, "label", ["vec_id"], 20).select(F.col("label").alias("identity_id"), "centroid")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Identities: a label's name; label 9 has none."""
    (embeddings,) = tables(spark, sf, "embeddings")
    ids = embeddings.select(F.col("label").cast("long").alias("id")).distinct()
    return ids.select("id", F.when(F.col("id") != 9, F.concat(F.lit("person "), F.col("id").cast("string"))).otherwise(F.lit("")).alias("name"))


@query(f"WITH {UNIT} SELECT vec_id, {joined('n')} AS unit FROM u")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return vec_faces(spark, sf).select("vec_id", shown(vectors.l2_normalize(F.col("embedding"))).alias("unit"))


@query(f"WITH {UNIT}, m AS ({mean_sql('e', 'label')}) SELECT CAST(label AS BIGINT) AS label, {joined('m')} AS centroid FROM m")
def identity_mean(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.mean_vector(vec_faces(spark, sf), "label").select("label", shown(F.col("centroid")).alias("centroid"))


@query(f"WITH {CENTROIDS} SELECT CAST(label AS BIGINT) AS identity_id, {joined('c')} AS centroid FROM c")
def identity_centroid_capped(spark: SparkSession, sf: str) -> DataFrame:
    return centroids(spark, sf).select("identity_id", shown(F.col("centroid")).alias("centroid"))


@query(f"WITH {CENTROIDS} SELECT vec_id AS i, CAST(other AS BIGINT) AS j, round(sim, 6) + 0.0 AS similarity FROM s")
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    a, b = vec_faces(spark, sf).select(F.col("vec_id").alias("i"), F.col("embedding").alias("va")), centroids(spark, sf).select(F.col("identity_id").alias("j"), F.col("centroid").alias("vb"))
    return similarity.pairwise_cosine(a, b).withColumn("similarity", F.round("similarity", 6) + F.lit(0.0))


@query(
    f"""WITH {CENTROIDS}, t AS (SELECT label, avg(days) AS mean_days FROM e GROUP BY label)
SELECT vec_id AS i, CAST(other AS BIGINT) AS j, round(sim * exp(-pow(days - mean_days, 2) / (2 * 30.0 * 30.0)), 6) + 0.0 AS similarity FROM s JOIN t ON t.label = other"""
)
def fused_similarity(spark: SparkSession, sf: str) -> DataFrame:
    faces = vec_faces(spark, sf)
    days = faces.groupBy(F.col("label").alias("identity_id")).agg(F.avg("days").alias("tb"))
    a = faces.select(F.col("vec_id").alias("i"), F.col("embedding").alias("va"), F.col("days").alias("ta"))
    b = centroids(spark, sf).join(days, "identity_id").select(F.col("identity_id").alias("j"), F.col("centroid").alias("vb"), "tb")
    return similarity.fused_similarity(a, b, 30.0).withColumn("similarity", F.round("similarity", 6) + F.lit(0.0))


@query(f"WITH {UNIT}, d AS (SELECT avg(days) AS m FROM e) SELECT vec_id, {joined('list_append(n, (days - m) / 30.0 * 0.15)', 5)} AS features FROM u CROSS JOIN d")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.feature_matrix(vec_faces(spark, sf)).select("vec_id", shown(F.col("features"), 5).alias("features"))


@query(
    f"""WITH {CENTROIDS}, d AS (SELECT avg(days) AS m FROM e), t AS (SELECT label, avg(days) AS p FROM e WHERE label <> 9 AND vec_id % 2 = 0 GROUP BY label)
SELECT CAST(c.label AS BIGINT) AS identity_id, {joined('list_append(c, (coalesce(p, m) - m) / 30.0 * 0.15)', 5)} AS features FROM c LEFT JOIN t ON t.label = c.label CROSS JOIN d"""
)
def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    faces, ids = vec_faces(spark, sf), labels(spark, sf)
    tag = F.when(F.col("vec_id") % 2 == 0, F.col("name"))
    named = faces.join(ids, faces.label == ids.id).select(tag.alias("person_name"), "days")
    return similarity.seed_rows(centroids(spark, sf), ids, named, faces).select("identity_id", shown(F.col("features"), 5).alias("features"))


ASSIGNED = (
    CENTROIDS
    + """,
used AS (SELECT best, dense_rank() OVER (ORDER BY best) - 1 AS cid FROM (SELECT DISTINCT best FROM b WHERE sim >= 0.25)),
r AS (SELECT photo_id, face_idx, CAST(CASE WHEN sim >= 0.25 THEN cid ELSE -1 END AS BIGINT) AS cluster_id, CASE WHEN b.label % 3 <> 0 THEN 'tag ' || b.label END AS person_name,
  CASE WHEN sim >= 0.25 THEN CASE WHEN b.best <> 9 THEN 'person ' || b.best ELSE '' END END AS predicted_name, CASE WHEN sim >= 0.25 THEN sim ELSE 0.0 END AS confidence
  FROM b LEFT JOIN used ON used.best = b.best)"""
)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    faces = vec_faces(spark, sf)
    known = faces.select("photo_id", "face_idx", F.when(F.col("label") % 3 != 0, F.concat(F.lit("tag "), F.col("label").cast("string"))).alias("person_name"))
    return assign.nearest_centroid(faces, labels(spark, sf), centroids(spark, sf), known, 0.25)


@query(f"WITH {ASSIGNED} SELECT photo_id, face_idx, cluster_id, person_name, predicted_name, round(confidence, 6) + 0.0 AS confidence FROM r")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).withColumn("confidence", F.round("confidence", 6) + F.lit(0.0))


@query(
    f"""WITH {ASSIGNED}, n AS (SELECT cluster_id, person_name, count(*) AS n, min((photo_id, face_idx)) AS f FROM r WHERE cluster_id >= 0 AND coalesce(person_name, '') <> '' GROUP BY 1, 2)
SELECT cluster_id, person_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS k FROM n) WHERE k = 1"""
)
def majority_vote_name(spark: SparkSession, sf: str) -> DataFrame:
    return naming.majority_names(assigned(spark, sf))


@query(
    f"""WITH {ASSIGNED}, g AS (SELECT cluster_id, CASE WHEN face_idx = 2 AND cluster_id % 2 = 0 THEN NULL WHEN cluster_id % 3 = 0 THEN NULL ELSE person_name END AS person_name, photo_id, face_idx FROM r),
n AS (SELECT cluster_id, person_name, count(*) AS n, min((photo_id, face_idx)) AS f FROM g WHERE cluster_id >= 0 AND coalesce(person_name, '') <> '' GROUP BY 1, 2),
v AS (SELECT cluster_id, person_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS k FROM n) WHERE k = 1),
z AS (SELECT CAST(label AS BIGINT) AS identity_id, CAST(label // 2 * 2 - CASE WHEN label < 4 THEN 0 ELSE label % 2 END AS BIGINT) AS x, CAST(CASE WHEN label < 4 THEN label // 2 ELSE label END AS BIGINT) AS cluster_id FROM (SELECT DISTINCT label FROM embeddings)),
w AS (SELECT cluster_id, min(identity_id) AS i FROM z GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT cluster_id, 'person ' || i AS name FROM w WHERE i <> 9)
SELECT photo_id, face_idx, g.cluster_id, CASE WHEN g.cluster_id >= 0 THEN coalesce(v.name, q.name) END AS predicted_name, CASE WHEN g.cluster_id >= 0 THEN 1.0 ELSE 0.0 END AS confidence
FROM g LEFT JOIN v ON v.cluster_id = g.cluster_id LEFT JOIN q ON q.cluster_id = g.cluster_id"""
)
def seed_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows, cid = assigned(spark, sf), F.col("cluster_id")
    rows = rows.withColumn("person_name", F.when((F.col("face_idx") == 2) & (F.pmod(cid, F.lit(2)) == 0), None).when(cid % 3 == 0, None).otherwise(F.col("person_name")))
    ids = labels(spark, sf)
    seeds = ids.select(F.col("id").alias("identity_id"), F.when(F.col("id") < 4, F.floor(F.col("id") / 2)).otherwise(F.col("id")).cast("long").alias("cluster_id"))
    named = naming.named(rows.drop("predicted_name", "confidence"), naming.majority_names(rows), naming.seed_names(seeds, ids))
    return named.select("photo_id", "face_idx", "cluster_id", "predicted_name", "confidence")


@query(
    f"""WITH {ASSIGNED} SELECT cluster_id, count(*) AS faces, CASE WHEN cluster_id = -1 THEN '—' ELSE coalesce(arg_min(predicted_name, (photo_id, face_idx)) FILTER (WHERE coalesce(predicted_name, '') <> ''), 'unknown') END AS assigned_name FROM r GROUP BY cluster_id"""
)
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    return naming.summary(assigned(spark, sf))


@query(
    f"""WITH {ASSIGNED}, z AS (SELECT cluster_id, count(*) AS n FROM r GROUP BY 1), w(name) AS (VALUES ('person 1'), ('person 4'), ('nobody'))
SELECT w.name, count(DISTINCT r.cluster_id) FILTER (WHERE r.cluster_id >= 0) AS clusters, count(r.cluster_id) FILTER (WHERE r.cluster_id >= 0) AS faces, coalesce(array_to_string(list_reverse_sort(list_distinct(list(z.n) FILTER (WHERE z.n IS NOT NULL)))[1:10], ','), '') AS top_sizes
FROM w LEFT JOIN r ON r.predicted_name = w.name LEFT JOIN z ON z.cluster_id = r.cluster_id GROUP BY w.name"""
)
def person_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return naming.breakdown(assigned(spark, sf), ["person 1", "person 4", "nobody"])


@query(
    f"""WITH {ASSIGNED}, z AS (SELECT cluster_id, count(*) AS faces, min((photo_id, face_idx)) AS f, arg_min(predicted_name, (photo_id, face_idx)) FILTER (WHERE coalesce(predicted_name, '') <> '') AS p FROM r GROUP BY 1)
SELECT row_number() OVER (ORDER BY cluster_id = -1, faces DESC, f) - 1 AS place, cluster_id, faces, CASE WHEN cluster_id = -1 THEN 'Noise / unassigned' ELSE 'Cluster ' || cluster_id || CASE WHEN p IS NOT NULL THEN ' — ' || p ELSE '' END END AS label,
  CASE WHEN cluster_id = -1 THEN 'badge-noise' WHEN p IS NOT NULL THEN 'badge-named' ELSE 'badge-unknown' END AS badge FROM z"""
)
def gallery_order(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ordinal import with_ordinal

    rows = with_ordinal(gallery.cluster_order(assigned(spark, sf)), [F.col("cluster_id") == -1, F.desc("faces"), F.col("first")], "place")
    return rows.select("place", "cluster_id", "faces", "label", "badge")


@query(
    f"""WITH {UNIT}, d AS (SELECT avg(days) AS m FROM e), f AS (SELECT vec_id, list_append(n, (days - m) / 30.0 * 0.15) AS x FROM u CROSS JOIN d),
p AS (SELECT a.vec_id, sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))) AS d FROM f a JOIN f b ON a.vec_id <> b.vec_id)
SELECT vec_id AS point, round(min(d), 5) AS core FROM p GROUP BY vec_id"""
)
def core_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.feature_matrix(vec_faces(spark, sf)).select(F.col("vec_id").alias("point"), "features")
    return hdbscan.core_distances(written(rows, "features")).select("point", F.round("core", 5).alias("core"))


@query()
def hdbscan_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Without the time feature: by it all points of these tables hang together."""
    rows = similarity.feature_matrix(vec_faces(spark, sf), temporal_sigma=0.0).select(F.col("vec_id").alias("point"), "features")
    return hdbscan.cluster(written(rows, "features"), cut=1.17)


@query()
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.pca(similarity.feature_matrix(vec_faces(spark, sf)), 8).select("vec_id", "features")


@query("SELECT vec_id // 3 AS photo_id, CAST(vec_id % 3 AS INT) AS face_idx, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings")
def embedding_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    back = written(vec_faces(spark, sf).select("photo_id", "face_idx", "embedding"), "embeddings")
    return back.select("photo_id", "face_idx", (F.round(F.aggregate(vectors.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


@query(f"WITH {ASSIGNED} SELECT cluster_id, count(*) AS rendered FROM r JOIN orders ON o_orderkey = photo_id GROUP BY cluster_id")
def gallery_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the gallery's pages, with a line of bytes for an image, and returns the counts shown."""
    photo = photo_rows(spark, sf).select("id", "digikam_date", "folder_date")
    rows = gallery.captions(assigned(spark, sf), photo).withColumn("jpeg", F.col("photo_id").cast("string").cast("binary"))
    return gallery.write_pages(written(rows, "gallery"), new_path(spark, "gallery"))


@query(
    f"""WITH {ASSIGNED}, p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS day, md5(CAST(o_orderkey AS VARCHAR)) AS jpeg FROM orders)
SELECT photo_id, face_idx, '<figure title="' || concat_ws(' | ', CASE WHEN coalesce(person_name, '') <> '' THEN person_name END, 'conf ' || CAST(round_even(confidence * 100, 0) AS BIGINT) || '%', strftime(day, '%Y-%m-%d')) || '"><img loading="lazy" alt="face" src="data:image/jpeg;base64,' ||
  base64(encode(jpeg)) || '">' || CASE WHEN coalesce(person_name, '') <> '' THEN '<figcaption>' || person_name || '</figcaption>' ELSE '' END || '</figure>' AS thumb
FROM r JOIN p ON o_orderkey = photo_id"""
)
def gallery_thumbs(spark: SparkSession, sf: str) -> DataFrame:
    """Each face as the gallery shows it, with its image as a data URL."""
    (orders,) = tables(spark, sf, "orders")
    photo = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("digikam_date"), F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("folder_date"))
    shown = gallery.captions(assigned(spark, sf), photo).join(orders.select(F.col("o_orderkey").alias("photo_id"), F.md5(F.col("o_orderkey").cast("string")).cast("binary").alias("jpeg")), "photo_id")
    return gallery.thumbs(shown).select("photo_id", "face_idx", "thumb")


# identities with their vectors, gaps filled from files, tags and days

#: Little-endian floats 1, 2 and -3, by customer.
_FLOATS = ("0000803F", "00000040", "000040C0")


@query(
    """SELECT n_nationkey AS id, n_name AS name, count(c_custkey) AS vectors, coalesce(string_agg([1, 2, -3][c_custkey % 3 + 1], ',' ORDER BY c_custkey), '') AS firsts
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""
)
def identity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    nation, customer = tables(spark, sf, "nation", "customer")
    attributes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("rowid"), F.lit("name").alias("attribute"), F.col("n_name").alias("value"))
    first = F.element_at(F.array(*map(F.lit, _FLOATS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    matrices = customer.select(F.col("c_nationkey").alias("identity"), F.col("c_custkey").alias("rowid"), F.unhex(F.concat(first, F.lit("0000003F"))).alias("embedding"))
    rows = photos.identities(attributes, matrices).join(photos.vector_counts(attributes, matrices).select("id", "vectors"), "id")
    return rows.select("id", "name", "vectors", F.array_join(F.transform("embeddings", lambda v: v[0].cast("int").cast("string")), ",").alias("firsts"))


@query(
    f"""WITH {PHOTOS} SELECT id, CASE WHEN id % 2 = 0 AND exif_date IS NOT NULL THEN exif_date WHEN id % 5 <> 0 THEN filename_date END AS exif_date,
  CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'maker' WHEN id % 3 = 0 THEN '' ELSE 'own' END AS camera_make, CASE WHEN camera_model IS NOT NULL THEN camera_model WHEN id % 5 <> 0 THEN 'model' END AS camera_model FROM photos"""
)
def exif_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = photo_rows(spark, sf), F.col("id")
    path = F.concat(F.lit("/p/"), k.cast("string"))
    tags = rows.where(k % 5 != 0).select(path.alias("full_path"), F.col("filename_date").alias("date"), F.lit("maker").alias("make"), F.lit("model").alias("model"))
    bare = rows.select("id", path.alias("full_path"), F.when(k % 2 == 0, F.col("exif_date")).alias("exif_date"), F.when(k % 3 == 0, "").otherwise("own").alias("camera_make"), "camera_model")
    return photos.fill_exif(bare, tags).drop("full_path")


@query(f"WITH {FACES} SELECT photo_id, CAST(face_idx AS INT) AS face_idx, p_partkey AS identity_id FROM faces JOIN part ON p_name = person_name")
def tagged_faces(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = tables(spark, sf, "part")
    ids = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return assign.tagged_faces(face_rows(spark, sf), ids, assign.PAIR_BLOCK).select("photo_id", "face_idx", "identity_id")


@query(f"WITH {CORRECTED} SELECT vec_id, round(CASE WHEN corrected_date IS NULL THEN 0.0 ELSE date_diff('microsecond', TIMESTAMP '2000-01-01', corrected_date) / 86400000000.0 END, 6) AS days FROM embeddings LEFT JOIN fixed ON id = vec_id // 3")
def face_days(spark: SparkSession, sf: str) -> DataFrame:
    faces = vec_faces(spark, sf).drop("days")
    return similarity.with_days(faces, datestamps.annotated(photo_rows(spark, sf), LIMITS)).select("vec_id", F.round("days", 6).alias("days"))


# an image says its size, a crop its box, and the model gives the box as a vector


def _decoded(data: bytes) -> tuple[int, int]:
    width, height = data.decode().split("x")
    return int(width), int(height)


def _cut(image: tuple[int, int], box: tuple[int, int, int, int]) -> bytes:
    return ",".join(map(str, box)).encode()


def _load() -> Callable:
    return lambda crops: [[float(x) for x in bytes(c).decode().split(",")] for c in crops]


CODEC = assign.Codec(_decoded, lambda image: image, _cut)


def pictures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photos, files of most of them, and thumbnails of others; one file in seven cannot be read."""
    (orders,) = tables(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = orders.select(k.alias("id"), F.concat(F.lit("/p/"), k.cast("string")).alias("full_path"), F.concat(F.lit("h"), k.cast("string")).alias("unique_hash"), F.lit(9).cast("long").alias("file_size"))
    files = rows.where("id % 3 <> 0").select("full_path", F.when(F.col("id") % 7 == 1, F.lit("broken")).otherwise(F.lit("40x60")).cast("binary").alias("content"))
    return rows, files, rows.where("id % 3 = 0").select("unique_hash", "file_size", F.lit("30x45").cast("binary").alias("data"))


BOXES = (
    FACES
    + """,
sized AS (SELECT *, CASE WHEN photo_id % 3 = 0 THEN 30 ELSE 40 END AS iw, CASE WHEN photo_id % 3 = 0 THEN 45 ELSE 60 END AS ih, CAST(trunc(width * 0.3) AS BIGINT) AS px, CAST(trunc(height * 0.3) AS BIGINT) AS py FROM faces WHERE photo_id % 3 = 0 OR photo_id % 7 <> 1),
boxes AS (SELECT *, greatest(0, x - px) AS x0, greatest(0, y - py) AS y0, least(iw, x + width + px) AS x1, least(ih, y + height + py) AS y1 FROM sized),
crops AS (SELECT * FROM boxes WHERE x1 - x0 >= 4 AND y1 - y0 >= 4)"""
)


@query(f"WITH {BOXES} SELECT photo_id, CAST(face_idx AS INT) AS face_idx, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS box FROM crops")
def embed_all_faces(spark: SparkSession, sf: str) -> DataFrame:
    rows, files, thumbs = pictures(spark, sf)
    found = assign.embed_faces(rows, face_rows(spark, sf), files, thumbs, CODEC, _load)
    return found.select("photo_id", "face_idx", F.array_join(F.transform("embedding", lambda v: v.cast("int").cast("string")), ",").alias("box"))


@query(
    f"""WITH {BOXES}, t AS (SELECT p_partkey AS id, f.photo_id, f.face_idx, row_number() OVER (PARTITION BY p_partkey ORDER BY f.photo_id, f.face_idx) AS k FROM faces f JOIN part ON p_name = person_name),
m AS (SELECT id, avg(x0) AS a, avg(y0) AS b, avg(x1) AS c, avg(y1) AS d FROM t JOIN crops ON crops.photo_id = t.photo_id AND crops.face_idx = t.face_idx WHERE k <= 5 GROUP BY id)
SELECT id AS identity_id, {joined("[a / n, b / n, c / n, d / n]", 5)} AS centroid FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM m)"""
)
def crop_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows, files, thumbs = pictures(spark, sf)
    (part,) = tables(spark, sf, "part")
    ids = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return assign.crop_centroids(face_rows(spark, sf), ids, rows, files, thumbs, CODEC, _load, 5).select("identity_id", shown(F.col("centroid"), 5).alias("centroid"))


@query(f"WITH {UNIT} SELECT DISTINCT CAST(label AS BIGINT) AS identity_id, CASE WHEN label <> 9 THEN 'person ' || label ELSE '' END AS name FROM u ORDER BY identity_id LIMIT 20")
def seeded_names(spark: SparkSession, sf: str) -> DataFrame:
    return naming.seeded_names(centroids(spark, sf), labels(spark, sf))


@query()
def clustering_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Faces clustered with the labels' centroids as seeds; the tests hold the parts against plain versions."""
    rows = datestamps.annotated(photo_rows(spark, sf), LIMITS).select("id", "corrected_date")
    faces = vec_faces(spark, sf).select("photo_id", "face_idx", "embedding", F.when(F.col("label") % 3 != 0, F.concat(F.lit("tag "), F.col("label").cast("string"))).alias("person_name"))
    found = clustering.clustered(rows, faces, faces, labels(spark, sf), centroids(spark, sf), temporal_sigma=0.0, cut=1.17)
    return found.select("photo_id", "face_idx", "cluster_id", "person_name", "predicted_name", "confidence")


@query()
def labelled_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The centroids' labels keep identities apart; without tags, seeds alone name clusters. Held against a plain version."""
    rows = datestamps.annotated(photo_rows(spark, sf), LIMITS).select("id", "corrected_date")
    faces = vec_faces(spark, sf).select("photo_id", "face_idx", "embedding", F.lit(None).cast("string").alias("person_name"))
    found = clustering.clustered(rows, faces, faces, labels(spark, sf), centroids(spark, sf), temporal_sigma=0.0, cut=1.17, labelled=True)
    return found.select("photo_id", "face_idx", "cluster_id", "predicted_name", "confidence")
