"""Files of a folder as rows, whole or in pieces: a data source with its own listing, which leaves out hidden files only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size long, content binary, error string"
#: Of pieces: the place of the first byte, and whether the piece is all of its file.
PIECES = "path string, size long, start long, whole boolean, content binary, error string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
#: White space that a piece may begin with. Its bytes are no part of a longer character in UTF-8.
_SPACE = re.compile(rb"[ \t\n\x0b\f\r]")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (as ``pyarrow.fs`` knows them) and the path in it."""
    kind, _, rest = path.partition(":")
    if "/" in kind or not rest:
        return pafs.LocalFileSystem(), path.rstrip("/")
    if kind == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/").rstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if kind == 's3a' else kind}:{rest.rstrip('/')}")


@dataclass
class Files(InputPartition):
    """(path below the root, size) of the files that a task reads, or their ``ranges``."""

    files: list[tuple]


def packed(files: list[tuple], limit: int, each: int = 4096) -> list[list[tuple]]:
    """Files in their order, in runs of about ``limit`` bytes (a file counts ``each`` more, for its opening); a larger file stands alone."""
    out: list[list[tuple]] = []
    room = 0
    for file in files:
        cost = file[1] + each
        if cost > room or not out:
            out.append([])
            room = limit
        out[-1].append(file)
        room -= cost
    return out


def ranges(path: str, size: int, limit: int) -> list[tuple[str, int, int, int, int | None]]:
    """(path, bytes, the file's size, first byte, byte behind the last) of a file's ranges of ``limit`` bytes. The last has no end: it goes on
    to where the file ends when it is read."""
    return [(path, min(limit, size - at), size, at, at + limit if at + limit < size else None) for at in range(0, max(size, 1), limit)]


def pieces(stream: pa.NativeFile, start: int, end: int | None, each: int, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(first byte, bytes, whether they are all of the file) of a range's pieces of about ``each`` bytes.

    A range goes from the first white space at or behind its start (the first one from the file's first byte) to the first at or behind its
    end, and its pieces are cut before white space too. So the ranges of a file hold each byte once, no word or character is cut, and a word
    without end is read by one range only. A word of more than ``most`` bytes is an error.
    """
    stream.seek(start)
    at, held = start, bytearray()

    def space(goal: int, stop: int | None = None) -> int | None:
        """How many held bytes come before the first white space at or behind ``goal``; none if the file, or what is before ``stop``, has no more."""
        seen = goal - at
        while True:
            if found := _SPACE.search(held, seen):
                return found.start()
            seen = max(seen, len(held))
            if stop is not None and at + seen >= stop:
                return None
            more = stream.read(min(each, 1 << 20))
            if not more:
                return None
            held.extend(more)
            if at + len(held) - goal > most:
                raise ValueError(f"a word larger than {most} bytes")

    if start:  # what comes first belongs to the range before
        first = space(start, end)
        if first is None or (end is not None and start + first >= end):
            return
        at += first
        del held[:first]
    while end is None or at < end:
        cut = space(at + each if end is None else min(at + each, end))
        if cut is None:
            if held or not at:
                yield at, bytes(held), not at
            return
        yield at, bytes(held[:cut]), False
        at += cut
        del held[:cut]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.recursive = options.get("recursive", "false") == "true"
        self.extensions = {e for e in options.get("extensions", "").split(",") if e}
        self.limit, self.most = int(options.get("partitionbytes", 64 << 20)), int(options.get("filebytes", 1 << 30))
        self.piece = int(options.get("piecebytes", 0))

    def wanted(self, below: str) -> bool:
        name = below.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        ending = name[dot + 1 :].lower() if dot > 0 else ""
        return not any(part.startswith(".") for part in below.split("/")) and (not self.extensions or ending in self.extensions)

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.root)
        listed = fs.get_file_info(pafs.FileSelector(root, recursive=self.recursive))
        below = sorted((f.path[len(root) :].lstrip("/"), f.size or 0) for f in listed if f.is_file)
        files = [f for f in below if self.wanted(f[0])]
        return [Files(run) for run in packed([r for f in files for r in ranges(*f, self.limit)] if self.piece else files, self.limit)]

    def files(self, partition: Files) -> Iterator[tuple]:
        fs, root = file_system(self.root)
        for path, size in partition.files:
            content, error = None, None
            try:
                if size > self.most:
                    raise ValueError(f"larger than {self.most} bytes")
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:  # a name must not choose it
                    content = stream.read(self.most + 1)
                if len(content) > self.most:
                    content = None
                    raise ValueError(f"larger than {self.most} bytes")
            except (OSError, ValueError) as fault:  # a file that can't be read is a row too
                error = str(fault)
            yield path, size, content, error

    def pieces(self, partition: Files) -> Iterator[tuple]:
        fs, root = file_system(self.root)
        for path, _, size, start, end in partition.files:
            alone = start == 0 and end is None
            try:
                with fs.open_input_file(f"{root}/{path}") as stream:
                    for at, content, whole in pieces(stream, start, end, self.piece, self.most):
                        yield path, size, at, whole, content, None
                        alone = False
            except (OSError, ValueError) as fault:
                yield path, size, start, alone, None, str(fault)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        columns = [c.split() for c in (PIECES if self.piece else SCHEMA).split(", ")]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(columns)], names=[c for c, _ in columns])

        for row in self.pieces(partition) if self.piece else self.files(partition):
            rows.append(row)
            held += len(row[-2] or b"")
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Folder(DataSource):
    """Options: path, recursive, extensions (comma-separated, lower case, without dots; none for all), partitionbytes, filebytes, piecebytes."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return PIECES if int(self.options.get("piecebytes", 0)) else SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


def read_folder(spark: SparkSession, root: str, extensions: list[str] | None = None, recursive: bool = False, partition_bytes: int = 64 << 20, file_bytes: int = 1 << 30, piece_bytes: int = 0) -> DataFrame:
    """path (below the root), size, content, error of a folder's regular files, those of hidden files and folders left out. Files are packed
    into tasks by their bytes; a file larger than ``file_bytes``, or one that can't be read, has an error and no content.

    With ``piece_bytes`` a file is rows of about so many bytes each, with start and whole, cut before white space; a file larger than
    ``partition_bytes`` is read by several tasks, and ``file_bytes`` is the limit of a word.
    """
    spark.dataSource.register(Folder)
    reader = spark.read.format("folder").option("recursive", str(recursive).lower()).option("extensions", ",".join(extensions or []))
    return reader.option("partitionbytes", str(partition_bytes)).option("filebytes", str(file_bytes)).option("piecebytes", str(piece_bytes)).load(root)
