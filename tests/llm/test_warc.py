import base64
import hashlib
import io

from kinfolio.llm import warc
from kinfolio.llm.common import new_path

SCHEMA = "page_id long, url string, html string, url_1 string"


def brute(rows, least=0):
    leads, out = {}, []
    for page_id, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        p = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = len(p) < least or digest not in leads
        if first and len(p) >= least:
            leads[digest] = page_id
        out.append((page_id, len(p), digest, "response" if first else "revisit", None if first else leads[digest]))
    return sorted(map(str, out))


def test_round_trip(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>é\r\n\r\nWARC/1.1" * (k % 5)) for k in range(200)]
    rows += [(300, None, None), (301, "u\r\nX: y", "body"), (None, "n", "body"), (None, None, "only"), (5, "http://x/5", rows[5][2]), (5, "http://x/5", rows[5][2]), (400, "big", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA).repartition(5)
    for least in (0, 20):
        got = warc.round_trip(df, min_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows, least)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_select_and_payload(spark):
    rows = [(k, f"http://x/{k}", f"page {k}") for k in range(50)]
    folder = new_path(spark, "warc-test")
    index = warc.write(warc.resolved(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)), folder)
    got = warc.read(index.where("page_id % 10 = 3"), folder).collect()
    assert {(r.page_id, r.url, bytes(r.payload)) for r in got} == {(k, f"http://x/{k}", f"page {k}".encode()) for k in range(3, 50, 10)}
    # an index made by scanning the archives equals the one made while writing
    paths = [r.path for r in index.select("path").distinct().collect()]
    scanned = warc.index(spark, paths, folder)
    assert sorted(map(str, scanned.collect())) == sorted(map(str, index.collect()))


def test_members_across_chunks():
    data = [warc.record(k, "u", bytes([65 + k]) * 500 * k, 500 * k, "D", None) for k in range(6)]
    found = list(warc.members(io.BytesIO(b"".join(data)), chunk=37))
    assert [n for _, n, _ in found] == [len(d) for d in data]
    assert warc.parse(found[3][2])["payload"] == b"D" * 1500


def test_a_row_repeated_often_has_one_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "LOT", 7)
    rows = [(5, "u", "same")] * 40 + [(5, None, "same"), (9, "u", "same"), (5, "u", "other")]
    got = warc.round_trip(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_urls_come_back_as_they_are(spark):
    urls = ["http://a/?q=x%0Ay%2520", "http://a/%0D", "a%25\nb%0A", "\r\n", "%", "plain", None]
    rows = [(k, u, f"same {k // 7}", "") for k, u in enumerate(urls * 2)]
    folder = new_path(spark, "warc-urls")
    index = warc.write(warc.resolved(spark.createDataFrame(rows, SCHEMA)), folder)
    want = sorted(((r[0], r[1]) for r in rows), key=str)
    assert sorted(((r.page_id, r.url) for r in warc.read(index, folder).collect()), key=str) == want
    assert sorted(((r.page_id, r.url) for r in warc.index(spark, [r.path for r in index.select("path").distinct().collect()], folder).collect()), key=str) == want
    data = warc.record(2, "a%0Ab", None, 3, "D", (1, "c\n%0A"))
    head = warc.parse(next(warc.members(io.BytesIO(data)))[2])
    assert head["WARC-Target-URI"] == "a%0Ab" and head["WARC-Refers-To-Target-URI"] == "c%0A%250A" and head[warc.ESCAPED] == "WARC-Refers-To-Target-URI"
