"""Python data sources for files that Spark has no format for: framed operation logs, objects by hash, tar archives.

They work on folders that the executors share under one path. Register them once a session with ``register_sources``.
"""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from palimpsest.operators.logs import split_frames


def clear_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it lies."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def _local(path: str) -> Path:
    return Path(path.removeprefix("file://"))


@dataclass
class _Files(InputPartition):
    paths: list[str]


class OplogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.top, self.files = options["path"], int(options.get("filesPerTask", 64))

    def partitions(self) -> list[InputPartition]:
        logs = sorted(str(p) for p in _local(self.top).glob("*/*.log"))
        return [_Files(logs[i : i + self.files]) for i in range(0, len(logs), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.paths:
            p = Path(name)
            for seq, update in enumerate(split_frames(p.read_bytes())):
                yield p.parent.name, p.stem, seq, update


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _FolderWriter(DataSourceWriter):
    """Files are written under names of their own and renamed into place when the whole job has ended."""

    def __init__(self, options: dict) -> None:
        self.top = options["path"]

    def _put(self, name: str, data: bytes) -> str:
        to = _local(self.top) / name
        to.parent.mkdir(parents=True, exist_ok=True)
        held = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
        held.write_bytes(data)
        return f"{held}\n{to}"

    def commit(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m else []:
                os.replace(*name.split("\n"))

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m else []:
                Path(name.split("\n")[0]).unlink(missing_ok=True)


class OplogWriter(_FolderWriter):
    """Rows vault, note_key, log: a file for each note."""

    def write(self, rows: Iterator) -> _Written:
        return _Written([self._put(f"{r.vault}/{r.note_key}.log", bytes(r.log)) for r in rows])


class ObjectWriter(_FolderWriter):
    """Rows hash, data: a file for each object, refused unless its bytes have that hash."""

    def write(self, rows: Iterator) -> _Written:
        names = []
        for r in rows:
            data = bytes(r.data)
            if hashlib.sha256(data).hexdigest() != r.hash:
                raise ValueError(f"the object's bytes do not have the hash {r.hash}")
            names.append(self._put(f"{r.hash[:2]}/{r.hash[2:]}", data))
        return _Written(names)


class TarWriter(_FolderWriter):
    """Rows path, data, mtime_ms: an archive for each task, a member a row, times in seconds, mode 0644."""

    def write(self, rows: Iterator) -> _Written:
        held = _local(self.top) / f".{uuid.uuid4().hex}.tar"
        held.parent.mkdir(parents=True, exist_ok=True)
        n = 0
        with tarfile.open(held, "w") as tar:
            for r in rows:
                info = tarfile.TarInfo(r.path)
                data = bytes(r.data)
                info.size, info.mtime, info.mode = len(data), r.mtime_ms // 1000, 0o644
                tar.addfile(info, io.BytesIO(data))
                n += 1
        if not n:
            held.unlink()
            return _Written([])
        return _Written([f"{held}\n{held.with_name(held.name[1:])}"])


class Oplog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> str:
        return "vault string, note_key string, seq long, update binary"

    def reader(self, schema) -> DataSourceReader:
        return OplogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OplogWriter(self.options)


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(self.options)


class Tar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TarWriter(self.options)


def register_sources(spark: SparkSession) -> None:
    for source in (Oplog, Objects, Tar):
        spark.dataSource.register(source)
