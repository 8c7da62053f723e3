"""Packages as a Spark data source: ``spark.read.format("packages")`` and ``df.write.format("packages")``.

Reading lists the files below a path, and each task reads a package's directory first and then inflates only the entries asked for:
filters on ``entry`` and ``doc_id`` go down to the source, so a job over headers reads no byte of a section. The file systems are those of
``pyarrow.fs`` by URI (local, HDFS, S3, GCS); where a path can be opened by Spark's readers alone, ``package.entries`` over ``package.files`` is the way.

Writing puts each row's bytes into a folder of the job's own beside the target; only when all tasks have succeeded does the driver
move the files to their names, and a failed or cancelled job, or a task that ran twice, leaves nothing behind.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

NAME = "packages"
SCHEMA = "doc_id string, entry_pos int, entry string, compress_type int, body binary"
#: Bytes of files that a reading task takes, and bytes of entries that it hands on at a time.
SPLIT, HANDED = 128 << 20, 16 << 20
#: Options and their defaults.
DEFAULTS = {"glob": "*.hwpx", "recursive": "true"}


def file_system(path: str):
    """(file system, path within it) of a URI or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _holds(f: Filter, value: str) -> bool:
    match f:
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case StringEndsWith():
            return value.endswith(f.value)
        case StringContains():
            return f.value in value
        case Not():
            return not _holds(f.child, value)
    raise ValueError(f)


def _column(f: Filter) -> str | None:
    """The column that a filter can be answered for here, if any."""
    if isinstance(f, Not):
        return _column(f.child)
    if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in ("entry", "doc_id"):
        return f.attribute[0]
    return None


def read_entries(file, name: str, wanted: Iterable[Filter] = ()) -> Iterator[tuple]:
    """(doc_id, entry_pos, entry, compress_type, body) of a seekable package file; only its directory and the entries that all filters hold for are read."""
    wanted = list(wanted)
    with zipfile.ZipFile(file) as z:
        for k, info in enumerate(z.infolist()):
            if not info.is_dir() and all(_holds(f, info.filename) for f in wanted):
                yield name, k, info.filename, info.compress_type, z.read(info)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str]]  # (path in the file system, doc_id)


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options, self.filters = options["path"], DEFAULTS | options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _column(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = file_system(self.path)
        found = system.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=self.options["recursive"].lower() == "true"))
        named = [(f.path, self.doc_id(f.path), f.size or 0) for f in files if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.options["glob"])]
        of_path = [f for f in self.filters if _column(f) == "doc_id"]
        parts, size = [], SPLIT
        for path, doc_id, n in sorted(n for n in named if all(_holds(f, n[1]) for f in of_path)):
            if size + n > SPLIT:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append((path, doc_id))
            size += n
        return parts or [Files([])]

    def doc_id(self, path: str) -> str:
        """A file's URI as Spark's own file sources write it."""
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        return f"file:{path}" if scheme == "file" else f"{scheme}://{path}"

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        of_entry = [f for f in self.filters if _column(f) == "entry"]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        system = file_system(self.path)[0] if partition.paths else None
        for path, doc_id in partition.paths:
            with system.open_input_file(path) as f:
                for row in read_entries(f, doc_id, of_entry):
                    rows.append(row)
                    size += len(row[4])
                    if size >= HANDED:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where the bytes are, the name they are for)


class PackageWriter(DataSourceArrowWriter):
    """Rows (name, content) as files of a folder."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator) -> Written:
        system, base = file_system(self.path)
        folder = posixpath.join(base, self.job, uuid.uuid4().hex)  # of this attempt alone
        system.create_dir(folder, recursive=True)
        done = []
        for b in batches:
            columns = b.schema.names
            for name, content in zip(b.column(columns.index("name")).to_pylist(), b.column(columns.index("content")), strict=True):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"no file name: {name!r}")
                part = posixpath.join(folder, str(len(done)))
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                done.append((part, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.path)
        files = [f for m in messages if m for f in m.files]
        try:
            names = [name for _, name in files]
            if len(set(names)) < len(names):
                raise ValueError("two rows have the same file name")
            if not self.overwrite:
                there = {f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.File}
                if there & set(names):
                    raise FileExistsError(f"there already: {sorted(there & set(names))[:5]}")
            for part, name in files:
                system.move(part, posixpath.join(base, name))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.path)
        folder = posixpath.join(base, self.job)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Packages(DataSource):
    """``path``: a folder or file. Reading: ``glob`` of file names (``*.hwpx``), ``recursive``. Writing takes columns ``name`` and ``content``; mode ``overwrite``
    replaces files of the same names, ``append`` fails where there are any."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("packages are written from columns name and content")
        return PackageWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format and may push filters down to it: Spark asks for this setting where a source can take filters."""
    if not getattr(spark, "_quiremill_packages", False):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(Packages)
        spark._quiremill_packages = True
    return spark
