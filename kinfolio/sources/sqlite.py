"""SQLite databases as a Spark data source: ``spark.read.format("sqlite").option("path", p).option("table", t)``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Columns of a library's tables that the operators read, with their types.
LIBRARY = {
    "AlbumRoots": "rowid long, specificPath string",
    "Albums": "id long, relativePath string",
    "Images": "id long, name string, fileSize long, uniqueHash string, album long, status int",
    "ImageInformation": "imageid long, creationDate string, width long, height long",
    "ImageMetadata": "imageid long, make string, model string",
    "Tags": "id long, pid long, name string",
    "ImageTagProperties": "rowid long, imageid long, tagid long, property string, value string",
    "IdentityAttributes": "rowid long, id long, attribute string, value string",
    "FaceMatrices": "rowid long, identity long, embedding binary",
    "Thumbnails": "id long, type int, data binary",
    "UniqueHashes": "uniqueHash string, fileSize long, thumbId long",
}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    """Read only; a file system that allows no locks is opened as immutable. A missing file is an error, not a new database."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    uri = Path(path).resolve().as_uri()
    try:
        conn = sqlite3.connect(f"{uri}?mode=ro", uri=True)
        conn.execute("SELECT 1 FROM sqlite_master LIMIT 1")
    except sqlite3.OperationalError:
        conn = sqlite3.connect(f"{uri}?immutable=1", uri=True)
    return conn


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    """Reads the schema's columns in rowid ranges; simple comparisons are evaluated by the database."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.path, self.table = schema.names, options["path"], options["table"]
        self.parts = int(options.get("partitions", "4"))
        self.tests: list[tuple[str, str, list[Any]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column and type(f) in COMPARISONS and isinstance(f.value, int | str | float):
                self.tests.append((column, COMPARISONS[type(f)] + " ?", [f.value]))
            elif column and isinstance(f, In) and all(isinstance(v, int | str | float) for v in f.value):
                self.tests.append((column, f"IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and isinstance(f, IsNotNull):
                self.tests.append((column, "IS NOT NULL", []))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        conn = connect(self.path)
        try:
            low, high = conn.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        finally:
            conn.close()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        conn = connect(self.path)
        conn.text_factory = lambda raw: raw.decode("utf-8", "replace")
        try:
            names = ", ".join("rowid" if c == "rowid" else quoted(c) for c in self.columns)
            where = " AND ".join(["rowid >= ? AND rowid < ?", *(f"{quoted(c) if c != 'rowid' else c} {test}" for c, test, _ in self.tests)])
            values = [v for _, _, vs in self.tests for v in vs]
            yield from conn.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where} ORDER BY rowid", [partition.low, partition.high, *values])
        finally:
            conn.close()


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options.get("columns") or LIBRARY[self.options["table"]]

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, columns: str | None = None) -> DataFrame:
    """A table of the database at ``path``; ``columns`` (DDL) for tables other than a library's."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table)
    return (reader.option("columns", columns) if columns else reader).load()
