"""WARC archives: records are indexed as they are written, then read by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_with_ids, new_path, written

INDEX = "path string, offset long, length long, url string, digest string, record_type string, page_id long, payload_bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Columns that come and go as strings, see ``map_with_ids``.
IDS = ("page_id", "refers_to")
#: Copies of a row that one task lists.
LOT = 10_000
#: Level of compression of the records; the size of an archive file past which a task begins the next one.
LEVEL, FILE_BYTES = 4, 512 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def identified(page_id: object) -> str:
    return f"<urn:page:{'none' if page_id is None or pd.isna(page_id) else page_id}>"


#: The fields of a record whose values are escaped, as line ends would end the header; others stand as they are.
ESCAPED = "WARC-X-Escaped"


def fields_of(values: dict[str, str | None]) -> list[str]:
    """Header lines of the values that are not null. One with a line end has it and all percent signs escaped, and is listed."""
    told = {k: v for k, v in values.items() if v is not None}
    listed = [k for k, v in told.items() if "\r" in v or "\n" in v]
    lines = [f"{k}: " + (v.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if k in listed else v) for k, v in told.items()]
    return lines + ([f"{ESCAPED}: {', '.join(listed)}"] if listed else [])


def record(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str, refers: tuple[object, str | None] | None) -> bytes:
    """One record, as a gzip member of its own. A revisit carries the HTTP head alone; ``size`` is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {identified(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    named = {"WARC-Target-URI": url}
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {identified(refers[0])}"]
        named["WARC-Refers-To-Target-URI"] = refers[1]
    head += fields_of(named)
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(data: bytes) -> dict:
    """The headers of an unpacked record, with ``payload``: what follows the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("truncated WARC record")
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def page_of(identifier: str | None) -> str | None:
    number = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return number if number.lstrip("-").isdigit() else None


def url_of(fields: dict) -> str | None:
    name = "WARC-Target-URI"
    url = fields.get(name)
    return url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if url and name in fields.get(ESCAPED, "").split(", ") else url


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` as records: page_id, url, payload, bytes, digest (SHA-1, hex), refers_to, refers_url, is_response.

    Of equal payloads of at least ``min_bytes`` the row with the smallest page_id (null last, then url) responds; among equal
    rows, one. A payload is shuffled with its digest, once a task however often it repeats, and revisits travel without:
    of them only ids and digests are grouped, so neither a hot payload nor a hot row meets in one task.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    least = F.col("bytes") < min_bytes
    lead = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").isNotNull().alias("named"), F.col("url").alias("url"))
    # equal digests are equal payloads
    groups = written(pages.where(~least).groupBy("digest", "bytes").agg(F.min(lead).alias("lead"), F.first("payload").alias("payload")), "payloads")
    first = groups.select("lead.page_id", "lead.url", "payload", "bytes", "digest")
    ids = pages.where(~least).groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("rows"))
    ids = ids.join(groups.select("digest", "lead"), "digest")
    leads = F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    again = ids.withColumn("rows", F.col("rows") - leads.cast("int")).where("rows > 0")
    # a row repeated very often is dealt out in lots before it becomes rows again
    again = written(again.select("page_id", "url", "bytes", "digest", "lead", "rows"), "revisits")
    lots = again.where(F.col("rows") > LOT).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / LOT)))).repartition("page_id", "digest", "lot")
    lots = lots.withColumn("rows", F.least(F.lit(LOT).cast("long"), F.col("rows") - F.col("lot") * LOT)).drop("lot")
    again = again.where(F.col("rows") <= LOT).unionByName(lots).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    no_id, no_url = F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url")
    columns = ("page_id", "url", "payload", "bytes", "digest")
    out = first.select(*columns, no_id, no_url, F.lit(True).alias("is_response"))
    out = out.unionByName(again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "bytes", "digest", F.col("lead.page_id").alias("refers_to"), F.col("lead.url").alias("refers_url"), F.lit(False).alias("is_response")))
    if min_bytes > 0:
        out = out.unionByName(pages.where(least).select(*columns, no_id, no_url, F.lit(True).alias("is_response")))
    return out


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of :func:`resolved` as archives under ``folder`` and returns the written index.

    Every attempt of a task writes files of its own name and only the attempt that Spark commits is in the index, so a
    repeated or speculative task does no harm. A task holds one record at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        part, out, path, at, k = TaskContext.get().partitionId(), None, "", 0, 0
        attempt = uuid.uuid4().hex[:12]
        try:
            for pdf in batches:
                index = []
                for page_id, url, payload, size, digest, is_response, refers_to, refers_url in pdf.itertuples(index=False):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, at, k = f"{top}/{part:05d}-{attempt}-{k}.warc.gz", 0, k + 1
                        out = fs.open_output_stream(path, compression=None)
                    digest = base64.b32encode(bytes.fromhex(digest)).decode()
                    data = record(page_id, url, bytes(payload) if is_response else None, size, digest, None if is_response else (refers_to, refers_url))
                    out.write(data)
                    index.append((path, at, len(data), url, digest, "response" if is_response else "revisit", page_id, size))
                    at += len(data)
                yield frame(index, INDEX)
        finally:
            if out is not None:
                out.close()

    rows = rows.select("page_id", "url", "payload", "bytes", "digest", "is_response", "refers_to", "refers_url")
    return written(map_with_ids(rows, run, INDEX, "page_id", "refers_to"), "warc-index")


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype="Int64" if kind == "long" and name not in IDS else "object") for k, (name, kind) in enumerate(fields)})


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of each gzip member of a stream, holding one member at a time."""
    offset, held, ended = 0, b"", False
    while True:
        unpack, used, parts = zlib.decompressobj(31), 0, []
        while not unpack.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    if used:
                        raise ValueError("truncated archive")
                    ended = True
                    break
            parts.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        if ended:
            return
        yield offset, used, b"".join(parts)
        offset += used


def index(spark: SparkSession, paths: Iterable[str], folder: str) -> DataFrame:
    """The index of archives that came without one: a streaming pass over each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for offset, length, data in members(stream):
                        f = parse(data)
                        rows.append((path, offset, length, url_of(f), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], page_of(f["WARC-Record-ID"]), int(f["WARC-X-Payload-Length"])))
                        if len(rows) == 1000:
                            yield frame(rows, INDEX)
                            rows = []
                    yield frame(rows, INDEX)

    paths = list(paths)
    return map_with_ids(spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path"), run, INDEX, *IDS)


def read(selected: DataFrame, folder: str, *, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records at the ``path, offset, length`` of ``selected`` index rows.

    Ranges are sorted by file and place; those at most ``gap`` bytes apart are read at once, up to ``most`` bytes. Each
    response's payload is checked against its digest.
    """

    def fetch(fs, path: str, run_: list[tuple[int, int]]) -> list[tuple]:
        with fs.open_input_file(path) as f:
            start = run_[0][0]
            data = f.read_at(run_[-1][0] + run_[-1][1] - start, start)
        rows = []
        for offset, length in run_:
            r = parse(gzip.decompress(data[offset - start : offset - start + length]))
            digest, payload, full = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload"], r["WARC-Type"] == "response"
            if full and base32_sha1(payload) != digest:
                raise ValueError(f"the payload at {path}:{offset} does not match its digest")
            rows.append((page_of(r["WARC-Record-ID"]), url_of(r), r["WARC-Type"], digest, len(payload) if full else int(r["WARC-X-Payload-Length"]), page_of(r.get("WARC-Refers-To")), payload if payloads and full else None))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        path, held = "", []
        for pdf in batches:
            for p, offset, length in pdf.itertuples(index=False):
                if held and (p != path or offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
                    yield frame(fetch(fs, path, held), RECORD)
                    held = []
                path = p
                held.append((int(offset), int(length)))
        if held:
            yield frame(fetch(fs, path, held), RECORD)

    spark = selected.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = selected.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return map_with_ids(ranges, run, RECORD, *IDS)


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Archives every row of ``pages`` and reads every record back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url. A null html is an empty payload; rows of
    equal page_id and html are records of their own, one of which responds; a null page_id orders last. A very long html is one record; an empty table gives no archive and an
    empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    selected = write(resolved(pages, min_bytes), folder)
    return read(selected, folder, payloads=False).drop("payload")
