"""Documents from a folder of files; failures are kept as rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.folder import read_folder

#: Bytes of a piece, and of the pieces that a task reads.
PIECE, PIECES = 1 << 20, 32 << 20
#: Of a file's pieces the last of these tells.
STATUS = ("ok", "decoding", "binary", "unreadable")


def relative_path(path: str | Column, root: str) -> Column:
    """Path below ``root``; unchanged outside of it."""
    path, root = F.col(path) if isinstance(path, str) else path, root.rstrip("/")
    return F.when(path.startswith(f"{root}/"), F.substr(path, F.lit(len(root) + 2))).when(path == root, "").otherwise(path)


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def normalized_extensions(extensions: Iterable[str]) -> list[str]:
    """Extensions trimmed, in lower case and without one leading dot; empty ones go."""
    return [e for e in (x.strip().removeprefix(".").lower() for x in extensions) if e]


def filter_extensions(df: DataFrame, extensions: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose file has one of the extensions (trimmed, one leading dot and letter case aside); no extensions keep all."""
    wanted = normalized_extensions(extensions)
    return df.where(extension(path).isin(wanted)) if wanted else df


def decode_documents(df: DataFrame, content: str = "content", head: Column | None = None) -> DataFrame:
    """Replace the bytes by status (ok, binary: a NUL among the first 4096 bytes, decoding: not UTF-8), error, contents. Where rows are pieces,
    ``head`` tells those that begin a file; a NUL in others means nothing."""
    text = F.try_validate_utf8(F.col(content).cast("string"))
    binary = F.locate("\0", F.decode(F.substring(content, 1, 4096), "ISO-8859-1")) > 0
    binary = binary if head is None else head & binary
    status = F.when(binary, "binary").when(text.isNull(), "decoding").otherwise("ok")
    error = F.when(binary, "binary file").when(text.isNull(), "not valid UTF-8")
    return df.select(*[c for c in df.columns if c != content], status.alias("status"), error.alias("error"), F.when(status == "ok", text).alias("contents"))


def read_corpus(spark: SparkSession, root: str, extensions: Iterable[str] = ("txt", "md"), recursive: bool = False, limit: int | None = None, file_bytes: int = 1 << 30, piece_bytes: int | None = None) -> DataFrame:
    """path (relative), status, error, contents of the files below ``root``, those of hidden files and folders left out. Empty files and
    names that begin with an underscore are read; a file that can't be read, or is larger than ``file_bytes``, is ``unreadable``.

    ``limit`` keeps the first so many documents, by path, that could be read; unreadable ones stay and don't count.

    With ``piece_bytes`` (4096 at least) a file that is ``ok`` may have any size: it is rows of about so many bytes each, with the place of
    their first (``start``), cut before white space so that words stay whole, and several tasks read a large one. Status and error are the
    file's, and one that isn't ``ok`` is one row. ``file_bytes`` is the limit of a word then.
    """
    if piece_bytes:
        files = read_folder(spark, root, normalized_extensions(extensions), recursive, PIECES, file_bytes, max(piece_bytes, 4096))
        return _of_pieces(_told(files, ["path", "start", "whole"], F.col("start") == 0), limit)
    docs = _told(read_folder(spark, root, normalized_extensions(extensions), recursive, file_bytes=file_bytes), ["path"])
    if limit is None:
        return docs
    # Paths alone are ordered, in one task at the end; contents stay where they are read.
    first = docs.where("status = 'ok'").select("path").orderBy("path").limit(max(limit, 0))
    wanted = docs.join(F.broadcast(first.withColumn("wanted", F.lit(True))), "path", "left")
    return wanted.where("status <> 'ok' OR wanted").drop("wanted")


def _told(files: DataFrame, keys: list[str], head: Column | None = None) -> DataFrame:
    """keys, status, error, contents of files or pieces that were read or couldn't be."""
    known = decode_documents(files.select(*keys, F.coalesce("content", F.lit(b"")).alias("content"), F.col("error").alias("fault")), head=head)
    broken = F.col("fault").isNotNull()
    return known.select(
        *keys,
        F.when(broken, "unreadable").otherwise(F.col("status")).alias("status"),
        F.coalesce("fault", "error").alias("error"),
        F.when(~broken, F.col("contents")).alias("contents"),
    )


def _of_pieces(pieces: DataFrame, limit: int | None) -> DataFrame:
    """Pieces with the status of their files. Only paths are shuffled; those sent are the first ones, or else those of broken files of several
    pieces: a file of one piece has its own status."""
    told = F.max(F.struct(F.array_position(F.lit(list(STATUS)), F.col("status")).alias("place"), "status", "error")).alias("told")
    files = pieces.where("NOT whole" if limit is None else "true").groupBy("path").agg(told).select("path", "told.status", "told.error")
    broken = files.where("status <> 'ok'")
    if limit is None:
        good = pieces.join(F.broadcast(broken.select("path")), "path", "left_anti")
    else:
        good = pieces.join(F.broadcast(files.where("status = 'ok'").select("path").orderBy("path").limit(max(limit, 0))), "path", "left_semi")
    rows = broken.select("path", F.lit(0).cast("long").alias("start"), "status", "error", F.lit(None).cast("string").alias("contents"))
    return good.drop("whole").unionByName(rows)
