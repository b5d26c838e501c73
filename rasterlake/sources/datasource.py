"""Spark data source ``dib``: reads bitmap files into images or only their headers, writes encoded images as files.

Paths are local folders that all machines mount, or URIs of file systems that pyarrow opens (file, hdfs, s3, gs). Files are dealt to
partitions by size. With option ``pixels`` = ``false`` only the first 138 bytes of a file are read (``HEADERS``).

Writes are staged: a task writes below ``<path>/.staging-<job>/``, files get their names when all tasks have succeeded, and only then an
overwrite deletes what it replaces. A job that fails leaves the folder as it was.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a partition's files, a file's share of them at least; bytes that hold every header.
PARTITION_BYTES, FILE_BYTES, HEADER_BYTES = 128 << 20, 1 << 20, 138
IMAGES = "path string, width int, height int, rgba binary, error string"
HEADERS = "path string, length long, variant string, file_size long, pixel_data_offset long, width long, height long, bit_count int, compression long, error string"


def open_fs(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def header(data: bytes) -> tuple:
    """variant, file_size, pixel_data_offset, width, height, bit_count, compression, error of a file's first bytes."""
    from rasterlake.sources.dib import SIZES

    if len(data) < 18:
        return (None,) * 7 + ("structural:Io",)
    size, offset, kind = struct.unpack_from("<I4xII", data, 2)
    if kind not in SIZES:
        return None, size, offset, None, None, None, None, "structural:UnsupportedStructure"
    if len(data) < 14 + kind:
        return SIZES[kind], size, offset, None, None, None, None, "structural:Io"
    width, height, bits, *compression = struct.unpack_from("<HH2xH" if kind == 12 else "<ii2xHI", data, 18)
    return SIZES[kind], size, offset, width, height, bits, *(compression or [None]), None


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pixels = options["path"], options.get("pixels", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        source, path = open_fs(self.path)
        info = source.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else source.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(path) :].split("/"))
        out, room = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f is not info and (not f.is_file or hidden(f.path) or not f.path.lower().endswith((".bmp", ".dib"))):
                continue
            cost = max(f.size if self.pixels else 0, FILE_BYTES)
            if cost > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(f.path)
            room -= cost
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from rasterlake.sources.dib import DibError, decode, parse

        source, _ = open_fs(self.path)
        for path in partition.value:
            with source.open_input_file(path) as f:
                if not self.pixels:
                    yield path, f.size(), *header(f.read_at(min(HEADER_BYTES, f.size()), 0))
                    continue
                data = f.read()
            try:
                img = decode(parse(data))
                yield path, img.shape[1], img.shape[0], img.tobytes(), None
            except DibError as e:
                yield path, None, None, None, f"{e.tier}:{e.code}"


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        target, _, staging = self._staging()
        target.create_dir(staging, recursive=True)  # here, so that a task that outlives an abort can't make it again

    def _staging(self) -> tuple:
        target, path = open_fs(self.path)
        return target, path, f"{path}/.staging-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Each attempt of a task has a folder of its own; of two rows with one id in a task the later counts."""
        target, _, staging = self._staging()
        folder, names = f"{staging}/{uuid.uuid4().hex}", {}
        target.create_dir(folder, recursive=False)
        for row in rows:
            names[f"{row.image_id}.bmp"] = None
            with target.open_output_stream(f"{folder}/{row.image_id}.bmp") as f:
                f.write(row.content)
        return _Staged(folder, list(names))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        target, path, staging = self._staging()
        target.create_dir(path, recursive=True)
        new = set()
        for m in messages:
            for name in m.names if m is not None else ():
                target.move(f"{m.folder}/{name}", f"{path}/{name}")
                new.add(name)
        if self.overwrite:
            for f in target.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.lower().endswith(".bmp") and f.base_name not in new:
                    target.delete_file(f.path)
        self._clear(target, staging)

    def abort(self, messages: list) -> None:
        target, _, staging = self._staging()
        self._clear(target, staging)

    @staticmethod
    def _clear(target, staging: str) -> None:
        for _ in range(50):  # tasks that are still running may add to it meanwhile
            if target.get_file_info(staging).type.name == "NotFound":
                return
            try:
                target.delete_dir(staging)
            except OSError:
                time.sleep(0.1)


class DibDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dib"

    def schema(self) -> str:
        return HEADERS if self.options.get("pixels", "true").lower() == "false" else IMAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
