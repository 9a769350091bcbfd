"""WARC archives whose records are Zstandard frames of their own, compressed with a dictionary that the archive carries.

A task writes archives of bounded size. It keeps the first records, up to ``SAMPLE`` bytes, builds a dictionary from them, writes that as a
leading skippable frame, and from then on compresses record by record, so any record can be read with the dictionary alone. Records with a
payload that occurs more than once are revisits of the one with the largest key; payloads are compared by their SHA-256 and
length, which are pre-aggregated, so that a payload with a third of all rows is no hot spot.

Archives are a Spark data source, ``warc_zstd``. Files are reached by way of ``pyarrow.fs``, so the folder is one that driver and executors share; a task
writes hidden files, which a commit names once all tasks are done. A reading task streams one archive and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sedimenta.llm.support import materialize

#: Bytes of an archive's first records that its dictionary is built from, and of the dictionary at most.
SAMPLE, DICTIONARY = 4 << 20, 112 << 10
#: Fixed values of the format: the magic number of the dictionary's skippable frame, and of a Zstandard frame.
_DICTIONARY_FRAME, _FRAME = 0x184D2A5D, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
SCHEMA = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


# --------------------------------------------------------------------------- records


def _urn(key: str | None) -> str:
    return f"<urn:row:{'?' if key is None else quote(key, safe='')}>"


def _key(urn: str) -> str | None:
    text = urn.removeprefix("<urn:row:").removesuffix(">")
    return None if text == "?" else unquote(text)


def _block(version: str, fields: dict[str, str | None]) -> bytes:
    lines = [version, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return _CRLF.join(x.encode() for x in lines) + 2 * _CRLF


def write_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or, with ``refers_to``, a revisit without the payload; both name the payload's digest and length."""
    http = _block("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    body = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(key),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " and c != "\x7f" else quote(c) for c in url),
        "WARC-Profile": None if refers_to is None else _PROFILE,
        "WARC-Refers-To": None if refers_to is None else _urn(refers_to),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(body)),
    }
    return _block("WARC/1.1", fields) + body + 2 * _CRLF


def _fields(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])


def read_record(record: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Header fields, payload (null for a revisit) and payload's length; an error if lengths or digest don't hold."""
    head, _, rest = record.partition(2 * _CRLF)
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if rest[size:] != 2 * _CRLF:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end where it says")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return fields, None, 0
    http, _, payload = rest[:size].partition(2 * _CRLF)
    said = int(_fields(http)["Content-Length"])
    if fields["WARC-Type"] == "revisit":
        return fields, None, said
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if len(payload) != said or digest != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} isn't what its record says")
    return fields, payload, said


# --------------------------------------------------------------------------- dictionaries and frames


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from records; too few of them are its content as they are."""
    import zstandard

    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(total // 8, 256)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed


def compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, frame by frame, by the dictionary in front."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = stream.read(size)
    if dictionary[:4] == struct.pack("<I", _FRAME):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = b""
    while rest or (rest := stream.read(chunk)):
        one, parts = tool.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(rest))
            rest = b""
        rest = one.unused_data
        yield b"".join(parts)


# --------------------------------------------------------------------------- data source


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    head, _, tail = path.partition(":")
    return pafs.FileSystem.from_uri(f"{'s3' if head == 's3a' else head}://{tail if tail.startswith('//') else '//' + tail}".replace(":////", "://"))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class Archive(InputPartition):
    name: str


@dataclass
class Roll:
    """Archives of one task, each ended when it has had ``limit`` bytes of records."""

    path: str
    date: str
    limit: int
    names: list[str] = field(default_factory=list)
    task: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.fs, self.folder = _files(self.path)
        self.sample, self.seen, self.out, self.tool = [], 0, None, None

    def add(self, record: bytes) -> None:
        self.seen += len(record)
        if self.out is None:
            self.sample.append(record)
            if self.seen >= min(SAMPLE, self.limit):
                self._open()
        else:
            self.out.write(self.tool.compress(record))
        if self.seen >= self.limit:
            self.close()

    def _open(self) -> None:
        name = f"{self.task}-{len(self.names):05d}.warc.zst"
        self.names.append(name)
        self.out = self.fs.open_output_stream(f"{self.folder}/.{name}", compression=None)  # a name must not choose it
        dictionary = build_dictionary([r for r in self.sample if len(r) <= SAMPLE])
        self.tool = compressor(dictionary)
        self.out.write(dictionary_frame(dictionary))
        info = b"software: sedimenta\r\nformat: WARC File Format 1.1\r\n"
        told = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": str(len(info))}
        for record in (_block("WARC/1.1", told) + info + 2 * _CRLF, *self.sample):
            self.out.write(self.tool.compress(record))
        self.sample = []

    def close(self) -> None:
        if self.sample and self.out is None:
            self._open()
        if self.out is not None:
            self.out.close()
        self.out, self.tool, self.seen = None, None, 0


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.date, self.limit = options["path"].rstrip("/"), options["date"], int(options["archivebytes"])
        fs, folder = _files(self.path)
        fs.create_dir(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        roll = Roll(self.path, self.date, self.limit)
        for batch in iterator:
            for key, url, payload, refers in zip(*(batch[c] for c in ("key", "url", "payload", "refers_to")), strict=True):
                roll.add(write_record(key.as_py(), url.as_py(), payload.as_py(), refers.as_py(), self.date))
        roll.close()
        return Written(roll.names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{folder}/.{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path.rstrip("/"), payloads

    def partitions(self) -> list[Archive]:
        fs, folder = _files(self.path)
        return [Archive(f.base_name) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no archives
            return
        fs, folder = _files(self.path)
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")] + ["payload"] * self.payloads
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * self.payloads
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        with fs.open_input_stream(f"{folder}/{partition.name}", compression=None) as stream:
            for record in frames(stream):
                told, payload, length = read_record(record)
                if told["WARC-Type"] not in ("response", "revisit"):
                    continue
                digest = base64.b32decode(told["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                refers = _key(told["WARC-Refers-To"]) if "WARC-Refers-To" in told else None
                row = (_key(told["WARC-Record-ID"]), told.get("WARC-Target-URI"), told["WARC-Type"], refers, length, digest)
                rows.append((*row, payload) if self.payloads else row)
                size += 200 + (len(payload or b"") if self.payloads else 0)
                if size > 4 << 20:
                    yield batch()
                    rows, size = [], 0
        yield batch()


class WarcZstd(DataSource):
    """Archives of a folder: a row per response and revisit, with the payload if the option ``payloads`` is true."""

    @classmethod
    def name(cls) -> str:
        return "warc_zstd"

    def schema(self) -> str:
        return SCHEMA + (", payload binary" if self.options.get("payloads") == "true" else "")

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("payloads") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def write_archives(pages: DataFrame, folder: str, key: str, url: str, payload: str, least: int = 1000, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row into archives of about ``archive_bytes`` of records below ``folder``. Of rows with equal payloads of ``least`` bytes and
    more, those with the largest key are responses and the others revisits of it.

    A null payload is empty; a null key is smaller than any, stays null, and where a payload has no other is a response. Rows that repeat
    with their key are responses both. A null url is left out. Columns beside these three aren't archived. An empty table makes no archive.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, F.concat(F.sha2("payload", 256), F.length("payload").cast("string"))))
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(materialize(groups, "payload-groups"), "same", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    ready = marked.select(F.col("id").cast("string").alias("key"), "url", "payload", refers.cast("string").alias("refers_to"))
    spark.dataSource.register(WarcZstd)
    ready.write.format("warc_zstd").mode("append").option("archivebytes", str(archive_bytes)).option("date", date).save(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record: key, url, record_type (response or revisit), refers_to, payload_bytes and payload_digest (hex SHA-1, both of
    the full payload), and, on request, payload (null for a revisit). An archive is one task; a response whose payload isn't what its record says is an error."""
    spark.dataSource.register(WarcZstd)
    return spark.read.format("warc_zstd").option("payloads", str(payloads).lower()).load(folder)
