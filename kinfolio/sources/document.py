"""One text file from the ordered lines of a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are in memory at once when parts are joined.
CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str


class DocumentWriter(DataSourceWriter):
    """Tasks write parts beside the file; the commit joins those of successful tasks, in order of partitions, under a name of
    its own and moves the whole into place, so a reader sees all of it or what was there before."""

    def __init__(self, path: str) -> None:
        self.path, self.folder = path, f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with system.open_output_stream(name) as out:
            for row in iterator:
                out.write(f"{row[0] or ''}\n".encode())
        return Part(task.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with system.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.place):
                with system.open_input_stream(part.name) as f:
                    while data := f.read(CHUNK):
                        out.write(data)
        system.move(whole, fs.FileSystem.from_uri(self.path)[1])
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: object, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_document(lines: DataFrame, path: str) -> None:
    """The first column of ``lines``, ordered as they are, as the lines of one file at ``path`` (a path or URI that executors
    share); a file there is replaced. A null is an empty line. The driver copies the parts a chunk at a time."""
    lines.sparkSession.dataSource.register(DocumentSource)
    lines.write.format("document").mode("overwrite").option("path", path).save()
