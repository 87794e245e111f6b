"""One named delimited file per task, written with a commit protocol.

A data source for ``df.write.format(...)``: tasks write under a folder of this
job, and the files get their names only when the whole job has succeeded. An
aborted job, or a task that was tried twice, leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from placelab.functions.text import task_slug
from placelab.operators.places import result_columns
from placelab.session import ship_package

SLUG = "task_slug"
FORMAT = "placelab_task_files"
_BUFFER = 1 << 20


def _filesystem(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def _text(value) -> str:
    """A value as Spark's own delimited writer prints it; nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if hasattr(value, "strftime"):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%f")
    return str(value)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task of the job, by their final names."""

    files: dict[str, str]


class TaskFileWriter(DataSourceWriter):
    """Writes sorted rows; every slug is in one partition."""

    def __init__(self, path: str, sep: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.sep, self.overwrite = path.rstrip("/"), sep, overwrite
        self.names = [n for n in schema.fieldNames() if n != SLUG]
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, target, slug = {}, None, None
        system, folder = _filesystem(f"{self.job}/{uuid.uuid4().hex}")
        system.create_dir(folder, recursive=True)
        buffer = io.StringIO()
        rows = csv.writer(buffer, delimiter=self.sep, lineterminator="\n")

        def flush(final: bool) -> None:
            if target is not None and (final or buffer.tell() > _BUFFER):
                target.write(buffer.getvalue().encode())
                buffer.seek(0)
                buffer.truncate()

        for row in iterator:
            if row[SLUG] != slug:
                flush(True)
                if target is not None:
                    target.close()
                slug = row[SLUG]
                files[f"{slug}.csv"] = f"{folder}/{slug}.csv"
                target = system.open_output_stream(files[f"{slug}.csv"])
                rows.writerow(self.names)
            rows.writerow([_text(row[n]) for n in self.names])
            flush(False)
        flush(True)
        if target is not None:
            target.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _filesystem(self.path)
        _, job = _filesystem(self.job)
        files = {name: at for m in messages if m for name, at in m.files.items()}
        there = system.get_file_info([f"{folder}/{name}" for name in files]) if files else []
        if taken := [i.base_name for i in there if i.type != fs.FileType.NotFound and not self.overwrite]:
            self.abort(messages)
            raise FileExistsError(f"{taken[0]} and {len(taken) - 1} more files are there already")
        for name, at in files.items():
            system.move(at, f"{folder}/{name}")
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, job = _filesystem(self.job)
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)


class TaskFiles(DataSource):
    """``df.write.format("placelab_task_files").option("path", folder)``; the slug column names the file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TaskFileWriter:
        return TaskFileWriter(self.options["path"], self.options.get("sep", "|"), schema, overwrite)


def write_task_files(places: DataFrame, path: str, sep: str = "|", mode: str = "append") -> str:
    """``<task_slug>.csv`` for every task that has places, each a single file with a header.

    Files that exist already are an error in mode ``append`` and are replaced in
    mode ``overwrite``. A task's rows are written by one worker as they stream by, in the order
    of ``rank`` if there is one; tasks are spread over the workers.
    """
    ship_package(places.sparkSession)
    places.sparkSession.dataSource.register(TaskFiles)
    slug = task_slug(F.col("task_id"), F.col("search_keyword"), F.col("search_location"))
    order = [c for c in ("rank",) if c in places.columns]
    named = places.withColumn(SLUG, slug).repartition(SLUG).sortWithinPartitions(SLUG, *order)
    rows = named.select(*result_columns(named).columns, SLUG)
    rows.write.format(FORMAT).mode(mode).option("path", path).option("sep", sep).save()
    return path
