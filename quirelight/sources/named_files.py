"""Files by exact name as a data source for writing: a job's files appear all together when it commits, and none of a job that failed.

Every task writes into a folder of its own attempt, under one folder of the job; committing moves the files of the tasks that succeeded to their names and removes
the rest. So a task that is run twice, or dies in between, leaves nothing under the final names (a task that is still at work when its job is given up may
leave its hidden folder). Paths may be local (shared by all executors) or
any that pyarrow opens.
"""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder and the names in it."""

    folder: str
    names: list[str]


class NamedFileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        kinds = [f.dataType for f in schema.fields]
        if len(kinds) != 2 or not isinstance(kinds[0], StringType) or not isinstance(kinds[1], (StringType, BinaryType)):
            raise ValueError("named files are written from two columns: a name, and a text or bytes")
        self.path, self.overwrite = path, overwrite
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = opened(self.path)
        folder = posixpath.join(root, self.job, uuid.uuid4().hex)
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        try:
            for name, content in iterator:
                if not name or name in (".", "..") or "/" in name or "\0" in name:
                    raise ValueError(f"not a file name: {name!r}")
                with fs.open_output_stream(posixpath.join(folder, name)) as f:
                    f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
                names.append(name)
        except BaseException:
            fs.delete_dir(folder)
            raise
        if len(set(names)) < len(names):
            raise ValueError("a name occurs twice")
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        try:
            if len(set(every)) < len(every):
                raise ValueError("a name occurs twice")
            if self.overwrite:
                for old in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                    if old.type == pafs.FileType.File and old.base_name not in every:
                        fs.delete_file(old.path)
            for m in done:
                for n in m.names:
                    fs.move(posixpath.join(m.folder, n), posixpath.join(root, n))
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        folder = posixpath.join(root, self.job)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"], schema, overwrite)


def write_named(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """files (name, content: a text or bytes) into a folder, each under its name; a null content is an empty file. With overwrite, other files of the folder go."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    files.sparkSession.dataSource.register(NamedFiles)
    files.write.format("named_files").option("path", path).mode("overwrite" if overwrite else "append").save()
