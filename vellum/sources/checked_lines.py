"""Published files with a checksum each: a Python data source whose tasks hash what they write.

Every task writes its lines to files of its own name and counts rows, bytes and
SHA-256 while it writes; its commit message carries one entry per file. The commit
writes the list of all files, which is what makes them valid: files of failed or
repeated attempts have other names and are never listed, so a lost executor leaves
garbage at worst, and an aborted job no list.

Paths are those of ``pyarrow.fs`` (local or mounted folders, object stores, HDFS);
the list has one line per file, so the driver holds file names, never contents.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "vellum-checked-lines"
LIST = "files.jsonl"
LISTED = "file string, rows long, bytes long, sha256 string"
#: A file is closed when it has this many bytes, so that readers can take it whole.
FILE_BYTES = 64 << 20
_BUFFER = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; ``file:/x`` is accepted for ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int, str]]


class _File:
    """One file being written and measured."""

    def __init__(self, folder: str):
        self.name = f"part-{uuid.uuid4().hex}.jsonl"
        system, path = located(folder)
        system.create_dir(path, recursive=True)
        self.stream, self.hash, self.rows, self.bytes, self.held = system.open_output_stream(f"{path}/{self.name}"), hashlib.sha256(), 0, 0, bytearray()

    def add(self, line: str):
        data = line.encode() + b"\n"
        self.hash.update(data)
        self.rows, self.bytes = self.rows + 1, self.bytes + len(data)
        self.held += data
        if len(self.held) >= _BUFFER:
            self.flush()

    def flush(self):
        self.stream.write(bytes(self.held))
        self.held.clear()

    def close(self) -> tuple[str, int, int, str]:
        self.flush()
        self.stream.close()
        return self.name, self.rows, self.bytes, self.hash.hexdigest()


class CheckedWriter(DataSourceWriter):
    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes

    def write(self, rows: Iterator) -> Written:
        done, current = [], None
        for row in rows:
            current = current or _File(self.folder)
            current.add(row[0])
            if current.bytes >= self.file_bytes:
                done.append(current.close())
                current = None
        return Written([*done, current.close()] if current else done)

    def commit(self, messages: list[Written | None]) -> None:
        """Write the list under another name and move it into place, so that a list is whole or absent."""
        system, path = located(self.folder)
        system.create_dir(path, recursive=True)
        listed = sorted(f for m in messages if m for f in m.files)
        draft = f"{path}/_{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as out:
            for name, rows, size, digest in listed:
                out.write(json.dumps({"file": name, "rows": rows, "bytes": size, "sha256": digest}).encode() + b"\n")
        system.move(draft, f"{path}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a list are not valid, so nothing has to be taken back."""


class CheckedLines(DataSource):
    """``df.write.format(FORMAT).option("path", folder)`` for a frame with one text column."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> CheckedWriter:
        return CheckedWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def write_lines(lines: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a frame with one text column; returns the list of its files."""
    spark = lines.sparkSession
    spark.dataSource.register(CheckedLines)
    if listed(spark, folder) is not None:
        raise ValueError(f"{folder} has been published already")
    lines.write.format(FORMAT).option("path", folder).option("fileBytes", str(file_bytes)).mode("append").save()
    return listed(spark, folder)


def listed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The list of a folder's files; none where it was never committed."""
    system, path = located(folder)
    if system.get_file_info(f"{path}/{LIST}").type == fs.FileType.NotFound:
        return None
    return spark.read.schema(LISTED).json(f"{folder}/{LIST}")


def list_digest(folder: str) -> str:
    """SHA-256 of the list itself, which stands for all that it lists."""
    system, path = located(folder)
    digest = hashlib.sha256()
    with system.open_input_stream(f"{path}/{LIST}") as stream:
        while block := stream.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()
