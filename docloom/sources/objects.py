"""Texts and files as objects of a store: a data source with a partitioned reader, and a writer that commits whole or not at all.

``register(spark)`` makes the format ``objects`` known.

* Reading: ``spark.read.format("objects").option("root", uri).option("suffixes", ".md,.txt").load()`` gives (path, length, content)
  of the files below ``root`` in order of path, found again and again in sub-folders; names that begin with a dot or an underscore
  are not objects. Files are dealt to tasks by size.
* Writing: ``df.write.format("objects").option("root", uri).option("existing", "fail").mode("append").save()`` puts each row's
  content (text or binary) at its path below ``root``. Tasks write to a staging folder beside it; the driver moves the files when
  all tasks are done, and drops the folder if one fails for good (a task still running then may leave part of it, which no reader takes
  for objects). ``existing``: ``fail`` refuses the whole write if any path is
  there already (create if absent), ``replace`` overwrites (the default with mode overwrite, which removes nothing else).

A path that is null, empty, absolute or leads out of the root, and a path that comes twice in one write, are errors; null
content is an empty object. A task that runs again stages its rows again under another name, so only the run that counts is moved.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PART_BYTES = 64 << 20


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", uri) else "file://" + posixpath.abspath(uri))
    return fs, path.rstrip("/")


def checked_path(path: str | None) -> str:
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "..")) or clean == "." or any(p.startswith("_staging-") for p in clean.split("/")):
        raise ValueError(f"{path!r} is no path of an object")
    return clean


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())

    def partitions(self) -> list[Files]:
        fs, root = _opened(self.root)
        found = []
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            name = f.path[len(root) + 1 :]
            hidden = any(p.startswith((".", "_")) for p in name.split("/"))
            if f.type == pafs.FileType.File and not hidden and (not self.suffixes or name.lower().endswith(self.suffixes)):
                found.append((name, f.size))
        out, room = [], 0
        for name, size in sorted(found):
            if room < size or not out:
                out.append([])
                room = PART_BYTES
            out[-1].append(name)
            room -= size + 4096
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.root)
        for name in partition.paths:
            with fs.open_input_stream(f"{root}/{name}") as f:
                content = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], ["path", "length", "content"])


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.existing = options["root"], options.get("existing", "replace" if overwrite else "fail")
        if self.existing not in ("fail", "replace"):
            raise ValueError(f"existing is fail or replace, not {self.existing}")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = _opened(self.root)
        mine = f"{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{mine}", recursive=True)
        moves: list[tuple[str, str]] = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                moves.append((f"{mine}/{len(moves)}", checked_path(path)))
                with fs.open_output_stream(f"{root}/{moves[-1][0]}") as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = _opened(self.root)
        moves = [m for x in messages if x for m in x.moves]
        to = [t for _, t in moves]
        try:
            if len(set(to)) < len(to):
                raise ValueError(f"{next(t for t in to if to.count(t) > 1)} comes twice")
            if self.existing == "fail":
                for at in range(0, len(to), 1000):
                    for f in fs.get_file_info([f"{root}/{t}" for t in to[at : at + 1000]]):
                        if f.type != pafs.FileType.NotFound:
                            raise FileExistsError(f"{f.path} exists")
            for folder in sorted({posixpath.dirname(t) for t in to}):
                fs.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
            for here, there in moves:
                fs.move(f"{root}/{here}", f"{root}/{there}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = _opened(self.root)
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Objects)
