"""Data source ``recordings``: one row for each file of a folder, and folders of files written from rows.

Read: path, stem, text of every file under a folder (or of one file, or of the files whose names fit a last part with
``*`` or ``?``), also of the members of ``.zip`` bundles there; an empty file is an empty text.  Names that begin with
``_`` or ``.`` are passed over, as Spark's own sources do.  The driver lists names and sizes; tasks of about ``size``
bytes read them.  Bytes that are no UTF-8 become replacement characters.

Written: columns stem and text (null: empty).  By default every task bundles its recordings in ``.zip`` files of about
``size`` bytes of text, with a member ``<stem><suffix>`` each; with ``loose=true`` each recording is a file of that name.
Tasks write under ``_temporary``; the commit checks all names, moves the files to their places, removes what an
overwrite replaces, and writes ``_SUCCESS`` last.  A failed or repeated task's files are never moved.  A stem that is
null, empty, holds ``/``, or begins with ``_`` or ``.`` is an error; so is one given twice where files are loose.  A
loose file replaces one of its name; bundles have names of their own.

Options: ``path``; ``suffix`` (read: only names that end so, all by default; written: ``.txt``); ``size`` (32 MB);
``loose``.  Modes: append and overwrite.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, SIZE, _BATCH = "recordings", 32 << 20, 4 << 20
_COLUMNS = ["path", "stem", "text"]


def _place(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what to put before such a path to name it outside."""
    scheme, authority, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(?=/))?(.*)", path.rstrip("/"), re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), os.path.abspath(rest), "file://"
    system, root = fs.FileSystem.from_uri(f"{scheme}:{authority or '//'}/")  # the rest may hold signs that a URI escapes
    inner, whole = root.rstrip("/") + rest, f"{scheme}:{authority or ''}{rest}"
    return system, inner, whole.removesuffix(inner)


def _shown(name: str) -> bool:
    return not name.startswith(("_", "."))


def _stem(name: str) -> str:
    name = posixpath.basename(name)
    dot = name.rfind(".")
    return name[:dot] if dot > 0 else name


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("size", SIZE))

    def partitions(self) -> list[_Files]:
        system, inner, _ = _place(self.path)
        folder, last = posixpath.split(inner)
        pattern = last if any(c in last for c in "*?[") else None
        root = folder if pattern else inner
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.Directory:
            infos = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
            infos = [x for x in infos if all(map(_shown, x.path[len(root) :].strip("/").split("/")))]
            infos = [x for x in infos if pattern is None or posixpath.dirname(x.path) == root and fnmatch.fnmatchcase(x.base_name, pattern)]
        else:
            infos = [found]
        parts, held = [_Files([])], 0
        for x in sorted((x for x in infos if x.path.endswith((self.suffix, ".zip"))), key=lambda x: x.path):
            cost = x.size + (64 << 10)  # opening a file takes about the time of reading so much
            if parts[-1].paths and held + cost > self.size:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(x.path)
            held += cost
        return parts

    def _texts(self, paths: list[str]) -> Iterator[tuple[str, str, bytes]]:
        system, _, before = _place(self.path)
        for path in paths:
            if not path.endswith(".zip"):
                with system.open_input_stream(path) as f:
                    yield before + path, _stem(path), f.read()
                continue
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for member in z.infolist():
                    if not member.is_dir() and member.filename.endswith(self.suffix) and _shown(posixpath.basename(member.filename)):
                        yield f"{before}{path}/{member.filename}", _stem(member.filename), z.read(member)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = [[], [], []]
        held = 0
        for path, stem, text in self._texts(partition.paths):
            for column, value in zip(rows, (path, stem, text.decode("utf-8", "replace")), strict=True):
                column.append(value)
            held += len(text) + 200
            if held > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], _COLUMNS)
                rows, held = [[], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], _COLUMNS)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        missing = {"stem", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.suffix, self.size, self.loose = options.get("suffix", ".txt"), int(options.get("size", SIZE)), options.get("loose", "false").lower() == "true"

    def _temporary(self, inner: str) -> str:
        return f"{inner}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        system, inner, _ = _place(self.path)
        folder, names = f"{part:05d}-{attempt}", []
        system.create_dir(f"{self._temporary(inner)}/{folder}", recursive=True)
        stream = bundle = None
        held = 0
        for batch in iterator:
            for stem, text in zip(batch.column("stem"), batch.column("text"), strict=True):
                stem, raw = stem.as_py(), (text.as_py() or "").encode()
                if not stem or "/" in stem or not _shown(stem):
                    raise ValueError(f"no file name can be made of stem {stem!r}")
                if self.loose:
                    names.append(stem + self.suffix)
                    with system.open_output_stream(f"{self._temporary(inner)}/{folder}/{names[-1]}") as f:
                        f.write(raw)
                    continue
                if bundle is None:
                    names.append(f"part-{part:05d}-{self.job}-{len(names):05d}.zip")
                    stream = system.open_output_stream(f"{self._temporary(inner)}/{folder}/{names[-1]}")
                    bundle, held = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), 0
                bundle.writestr(zipfile.ZipInfo(stem + self.suffix), raw, zipfile.ZIP_DEFLATED)
                held += len(raw) + 200
                if held >= self.size:
                    bundle.close()
                    stream.close()
                    bundle = None
        if bundle is not None:
            bundle.close()
            stream.close()
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner, _ = _place(self.path)
        files = [(m.folder, n) for m in messages if m is not None for n in m.names]
        names = {n for _, n in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("a stem is given twice")
        system.create_dir(inner, recursive=True)
        old = []
        if self.overwrite:
            old = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name not in names and x.base_name != "_temporary"]
        for folder, name in files:
            system.move(f"{self._temporary(inner)}/{folder}/{name}", f"{inner}/{name}")
        for x in old:
            (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        self.abort(messages)
        with system.open_output_stream(f"{inner}/_SUCCESS") as f:
            f.write(json.dumps({"job": self.job, "files": len(files)}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, inner, _ = _place(self.path)
        if system.get_file_info(self._temporary(inner)).type == fs.FileType.Directory:
            system.delete_dir(self._temporary(inner))
        if system.get_file_info(f"{inner}/_temporary").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{inner}/_temporary")):
            system.delete_dir(f"{inner}/_temporary")


class RecordingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, stem string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RecordingFiles)
    return spark
