"""Files of concatenated frames as a Python data source: ``framed``.

``path`` is local or a URI that pyarrow opens; :func:`read_frames` reads whatever Spark can.
Options: ``path``; ``framing`` is ``standard``, ``packed`` (the whole file is packed) or ``flat``
(one unframed segment a file). Rows: ``file``, ``seq`` (from 0 in the file), ``segments``.
"""

from __future__ import annotations

import io
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.frames import MAX_SEGMENTS, MAX_WORDS, pack_many, unpack_some

SCHEMA = "file string, seq long, segments array<binary>"


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str


CHUNK = 1 << 20  # packed bytes read at a time


def _chunks(stream, framing: str):
    """The plain bytes of a stream, so many at a time."""
    packed = b""
    while more := stream.read(CHUNK):
        if framing == "standard":
            yield more
            continue
        out, used = unpack_some(packed + more)
        packed = (packed + more)[used:]
        yield out
    if packed:
        raise ValueError("it ends within a packed word")


def frames_of(stream, framing: str, name: str):
    """The messages of an open file, each a list of segments, one chunk in memory at a time; an error
    names the byte where one breaks off."""
    if framing == "flat":
        raw = stream.read()
        if not raw or len(raw) % 8:
            raise ValueError(f"{name} is not a whole number of words")
        yield [raw]
        return
    chunks, buffer, pos, at = _chunks(stream, framing), b"", 0, 0  # at: of buffer[0] in the file

    def need(n: int) -> bool:
        """Whether ``n`` bytes follow; reads on until they do."""
        nonlocal buffer, pos, at
        if len(buffer) - pos >= n:
            return True
        parts, size = [buffer[pos:]], len(buffer) - pos
        at += pos
        while size < n and (more := next(chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        buffer, pos = b"".join(parts), 0
        return size >= n

    while need(1):
        broken = f"{name}: the frame at byte {at + pos} breaks off"
        if not need(4):
            raise ValueError(broken)
        n = struct.unpack_from("<I", buffer, pos)[0] + 1
        if n > MAX_SEGMENTS:
            raise ValueError(f"{name}: the frame at byte {at + pos} names {n} segments")
        head = 8 * (n // 2 + 1)
        if not need(head):
            raise ValueError(broken)
        sizes = struct.unpack_from(f"<{n}I", buffer, pos + 4)
        if sum(sizes) > MAX_WORDS:
            raise ValueError(f"{name}: the frame at byte {at + pos} names {sum(sizes)} words")
        if not need(head + 8 * sum(sizes)):
            raise ValueError(broken)
        pos += head
        segments = []
        for size in sizes:
            segments.append(buffer[pos : pos + 8 * size])
            pos += 8 * size
        yield segments


ROWS, BYTES = 10_000, 1 << 24  # of a batch that is handed on
_ARROW = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("segments", pa.list_(pa.binary()))])


def batches_of(stream, framing: str, name: str):
    """The rows of an open file as Arrow batches."""
    held, size, first = [], 0, 0

    def batch() -> pa.RecordBatch:
        seqs = pa.array(range(first, first + len(held)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), seqs, pa.array(held, pa.list_(pa.binary()))], schema=_ARROW)

    for segments in frames_of(stream, framing, name):
        held.append(segments)
        size += sum(map(len, segments))
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size, first = [], 0, first + len(held)
    if held:
        yield batch()


def packed_frames(batches, framing: str):
    """Arrow batches of rows as the bytes of a file, some frames at a time."""
    form = lambda frames: b"".join(pack_many(frames) if framing == "packed" else frames)
    for batch in batches:
        column, held, size = batch.column(batch.schema.get_field_index("segments")), [], 0
        for first in range(0, len(column), 256):
            frames = [join_frame(segments) for segments in column.slice(first, 256).to_pylist()]
            held += frames
            size += sum(map(len, frames))
            if size >= CHUNK:
                yield form(held)
                held, size = [], 0
        yield form(held)


def join_frame(segments: list[bytes]) -> bytes:
    if not 1 <= len(segments) <= MAX_SEGMENTS or any(len(s) % 8 for s in segments):
        raise ValueError("a frame has 1 to 512 segments of whole words")
    table = struct.pack(f"<{len(segments) + 1}I", len(segments) - 1, *(len(s) // 8 for s in segments))
    return table.ljust(-(-len(table) // 8) * 8, b"\0") + b"".join(segments)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_frames(spark: SparkSession, path: str, framing: str = "standard") -> DataFrame:
    """The rows of the source by way of Spark's own file reader, for stores that only it opens."""

    def split(batches):
        for batch in batches:
            for name, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                yield from batches_of(io.BytesIO(raw), framing, name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, SCHEMA)


class FramedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.framing = options["path"], options.get("framing", "standard")

    def partitions(self):
        from pyarrow import fs

        where, path = _filesystem(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(path, recursive=True))
            return [OneFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(path) :].split("/"))]
        return [OneFile(path)]

    def read(self, partition):
        where, _ = _filesystem(self.path)
        with where.open_input_stream(partition.path) as f:
            yield from batches_of(f, self.framing, partition.path)


class FramedWriter(DataSourceArrowWriter):
    """Tasks write below ``_temporary``; only what the commit names moves to its place, so attempts
    that failed or came twice leave nothing that a reader takes."""

    def __init__(self, options, overwrite: bool):
        self.path, self.framing, self.overwrite = options["path"], options.get("framing", "standard"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        where, path = _filesystem(self.path)
        name = f"{path}/_temporary/{self.run}/part-{uuid.uuid4().hex}.frames"
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name) as f:
            for part in packed_frames(iterator, self.framing):
                f.write(part)
        return Written(name)

    def commit(self, messages):
        from pyarrow import fs

        where, path = _filesystem(self.path)
        where.create_dir(path, recursive=True)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File:
                    where.delete_file(old.path)
        for m in messages:
            if m is not None:
                where.move(m.path, f"{path}/{m.path.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        where, path = _filesystem(self.path)
        if where.get_file_info(f"{path}/_temporary/{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/_temporary/{self.run}")


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FramedReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return FramedWriter(self.options, overwrite)
