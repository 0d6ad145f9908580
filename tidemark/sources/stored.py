"""Stored files as a Spark data source: one row per file, however large, read in blocks.

Spark's own file sources put a whole file into a row (at most 2 GB) and never show files without bytes. This source lists
the files once when the query is planned, deals them to tasks by size, and each task reads its files block by block.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "tidemark_stored"
SCHEMA = "name string, bytes long, modified timestamp, sha256 string"
BLOCK = 1 << 20  # bytes that a task holds at once
SHARE = 256 << 20  # bytes of files that one task reads; a larger file is a task of its own
MOST = 1000  # files of one task


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; a path without a scheme is local."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    where, name = fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))
    return where, name.rstrip("/")


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows  # name, bytes, modified


class StoredReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.hashed = options.get("hashed", "true") == "true"

    def listed(self) -> list[tuple]:
        """As Spark does, names that begin with a point or an underscore are passed over, folders with such names too."""
        where, base = located(self.path)
        found = []
        for info in where.get_file_info(fs.FileSelector(base, recursive=True)):
            name = info.path[len(base) :].strip("/")
            if info.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in name.split("/")):
                if fnmatch.fnmatchcase(info.base_name, self.pattern):
                    found.append((name, info.size, info.mtime))
        return found

    def partitions(self) -> list[Files]:
        dealt: list[list[tuple]] = []
        room = 0
        for row in sorted(self.listed(), key=lambda r: (-r[1], r[0])):
            if room < row[1] or not dealt or len(dealt[-1]) == MOST:
                dealt.append([])
                room = SHARE
            dealt[-1].append(row)
            room -= row[1]
        return [Files(rows) for rows in dealt] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, base = located(self.path)
        for name, size, modified in partition.rows:
            body = self.body_hash(where, f"{base}/{name}") if self.hashed else None
            yield pa.record_batch(
                [
                    pa.array([name], pa.string()), pa.array([size], pa.int64()),
                    pa.array([modified], pa.timestamp("us", tz="UTC")), pa.array([body], pa.string()),
                ],
                names=["name", "bytes", "modified", "sha256"],
            )

    @staticmethod
    def body_hash(where: fs.FileSystem, path: str) -> str:
        """sha256 of what a ``.gz`` file holds, or of the bytes as stored."""
        found = hashlib.sha256()
        with where.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as body:
            while block := body.read(BLOCK):
                found.update(block)
        return found.hexdigest()


class StoredFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoredReader:
        return StoredReader(self.options)


def read(spark: SparkSession, path: str, pattern: str = "*", hashed: bool = True) -> DataFrame:
    """name, bytes, modified, sha256 (null if not ``hashed``) of every file below ``path`` whose base name fits the pattern."""
    spark.dataSource.register(StoredFiles)
    return spark.read.format(FORMAT).options(path=path, pattern=pattern, hashed=str(hashed).lower()).load()
