"""A data source for zip archives: one partition per member, read by seeks.

    spark.dataSource.register(ZippedLines)
    spark.read.format("zipped_lines").load("/data/*.zip")   # value, member, archive

Planning reads only the central directories. A task opens its archive, seeks to its member and
streams it, so neither an archive nor a member is ever held whole, and archives may pass 2 GB.
An archive inside an archive is one partition and is streamed too. A broken archive or member ends
the job with an error that names it."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "value string, member string, archive string"
ARROW = pa.schema([("value", pa.string()), ("member", pa.string()), ("archive", pa.string())])
# A batch ends at this many lines or characters.
BATCH_LINES, BATCH_CHARS = 20_000, 4_000_000
PLANNING_THREADS = 16


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def archives_at(path: str) -> list[str]:
    """Archives of a folder, a glob in its last part, or the one file, in order of their names."""
    folder, pattern = posixpath.split(path.rstrip("/"))
    if not any(c in pattern for c in "*?["):
        system, place = file_system(path)
        if system.get_file_info(place).type != fs.FileType.Directory:
            return [path]
        folder, pattern = path.rstrip("/"), "*.zip"
    system, place = file_system(folder)
    found = system.get_file_info(fs.FileSelector(place))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, pattern))


def _opened(archive: str):
    """A handle that seeks; small files whole, because zipfile tries to seek before their start."""
    system, place = file_system(archive)
    f = system.open_input_file(place)
    if f.size() >= 4096:
        return f
    with f:
        return io.BytesIO(f.read())


def _kind(name: str) -> str | None:
    low = name.lower()
    return "zip" if low.endswith(".zip") else "csv" if low.endswith(".csv") else None


@dataclass
class Member(InputPartition):
    archive: str
    name: str

    def __post_init__(self):
        self.value = (self.archive, self.name)


def members_of(archive: str) -> list[Member]:
    try:
        with _opened(archive) as f, zipfile.ZipFile(f) as z:
            return [Member(archive, i.filename) for i in z.infolist() if _kind(i.filename) and i.file_size]
    except zipfile.BadZipFile as e:
        raise ValueError(f"{archive}: {e}") from e


def _lines(z: zipfile.ZipFile, name: str, inside: str):
    """(member, line) of one member. Members of an inner archive are taken in the order in which they
    lie, so that its stream only moves forward after its directory is read."""
    try:
        with z.open(name) as raw:
            if _kind(name) == "csv":
                for line in io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""):
                    text = line.rstrip("\r\n")
                    if text:
                        yield inside + name, text
                return
            with zipfile.ZipFile(raw) as inner:
                for i in sorted(inner.infolist(), key=lambda i: i.header_offset):
                    if _kind(i.filename) and i.file_size:
                        yield from _lines(inner, i.filename, f"{inside}{name}/")
    except (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError) as e:
        raise ValueError(f"{inside}{name}: {e}") from e


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with ThreadPoolExecutor(PLANNING_THREADS) as pool:
            found = [m for part in pool.map(members_of, archives_at(self.path)) for m in part]
        # Without any member one empty partition keeps the frame readable.
        return found or [Member("", "")]

    def read(self, partition):
        if not partition.archive:
            return
        texts, names, chars = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(names), pa.array([partition.archive] * len(texts))], schema=ARROW)

        with _opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            try:
                for name, text in _lines(z, partition.name, ""):
                    texts.append(text)
                    names.append(name)
                    chars += len(text)
                    if len(texts) == BATCH_LINES or chars > BATCH_CHARS:
                        yield batch()
                        texts, names, chars = [], [], 0
            except ValueError as e:
                raise ValueError(f"{partition.archive}: {e}") from e
        if texts:
            yield batch()


class ZippedLines(DataSource):
    """Non-empty lines of every CSV in the archives at `path`."""

    @classmethod
    def name(cls):
        return "zipped_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def archive_lines(spark: SparkSession, path: str):
    spark.dataSource.register(ZippedLines)
    return spark.read.format("zipped_lines").load(path)
