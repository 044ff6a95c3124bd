"""Scalars of training logs as event files, written and read by a Python data source.

An event file is a sequence of framed records: the length, a checksum of it, the record, and a
checksum of that; the checksums are masked CRC-32C. A record is an event message with the time, the
step and one scalar; the first record names the version.

Each task writes a file of its own into a staging folder and tells the driver its name. Only when all tasks have
ended does the driver move the files to their place; if one fails for good, the staging folder goes, so a job that
fails, or a task that is run again, leaves no file. The reader checks every length and checksum.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .stores import store

SCHEMA = "wall_time double, step long, tag string, value float"
# Fixed values of the format: the checksum's polynomial (reversed) and mask, the version record, the start of files' names.
POLYNOMIAL, MASK, VERSION, PREFIX = 0x82F63B78, 0xA282EAD8, "brain.Event:2", "events.out.tfevents"


def _table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [v >> 1 ^ POLYNOMIAL if v & 1 else v >> 1 for v in table]
    return table


_CRC = _table()


def masked_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _CRC[(crc ^ byte) & 0xFF] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + MASK) & 0xFFFFFFFF


def framed(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return length + struct.pack("<I", masked_crc(length)) + record + struct.pack("<I", masked_crc(record))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _sized(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def scalar_event(wall_time: float, step: int, tag: str, value: float) -> bytes:
    summary = _sized(1, _sized(1, tag.encode()) + struct.pack("<Bf", 2 << 3 | 5, value))
    return struct.pack("<Bd", 1 << 3 | 1, wall_time) + _varint(2 << 3) + _varint(step) + _sized(5, summary)


def version_event(wall_time: float = 0.0) -> bytes:
    return struct.pack("<Bd", 1 << 3 | 1, wall_time) + _sized(3, VERSION.encode())


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = body[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(body):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        if at + size > len(body):
            raise ValueError("an event ends inside a field")
        yield key >> 3, body[at : at + size]
        at += size


def parse_event(record: bytes) -> list[tuple[float, int, str, float]]:
    """The scalars of an event: (wall_time, step, tag, value); none for one without."""
    event = {1: struct.pack("<d", 0.0), 2: 0}
    values = []
    for field, value in _fields(record):
        if field == 5:
            values += [dict(_fields(v)) for f, v in _fields(value) if f == 1]
        else:
            event[field] = value
    step = event[2] - (1 << 64) if event[2] >> 63 else event[2]
    return [(struct.unpack("<d", event[1])[0], step, v[1].decode(), struct.unpack("<f", v[2])[0]) for v in values if 1 in v and 2 in v]


def records(stream) -> Iterator[bytes]:
    """The records of a file; a length or checksum that is wrong, or an end inside a record, is an error."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
            raise ValueError("a record's length is damaged")
        (size,) = struct.unpack("<Q", head[:8])
        body = stream.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked_crc(body[:size]):
            raise ValueError("a record is damaged")
        yield body[:size]


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"])

    def reader(self, schema) -> EventReader:
        return EventReader(self.options["path"])


class EventWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri, self.staging = uri.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.uri)
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        name, rows = f"{PREFIX}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(f"{root}/{self.staging}/{name}") as out:
            out.write(framed(version_event()))
            for batch in iterator:
                out.write(b"".join(framed(scalar_event(*r)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.uri)
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{root}/{self.staging}/{m.name}", f"{root}/{m.name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.uri))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")


class EventReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def partitions(self) -> list[File]:
        system, root = store(self.uri)
        found = system.get_file_info(fs.FileSelector(root))
        return [File(f.base_name) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.startswith(PREFIX)]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        system, root = store(self.uri)
        with system.open_input_stream(f"{root}/{partition.path}") as stream:
            for record in records(stream):
                yield from parse_event(record)


def write_events(series: DataFrame, path: str) -> None:
    """Scalars (tag, step, value and, if there, wall_time in seconds) as event files under ``path``, a file a partition.

    Rows with a null tag, step or value are no scalars. Values are single-precision.
    """
    series.sparkSession.dataSource.register(EventFiles)
    time = F.coalesce(F.col("wall_time").cast("double"), F.lit(0.0)) if "wall_time" in series.columns else F.lit(0.0)
    rows = series.where("tag IS NOT NULL AND step IS NOT NULL AND value IS NOT NULL")
    rows.select(time.alias("wall_time"), F.col("step").cast("long").alias("step"), F.col("tag").cast("string").alias("tag"), F.col("value").cast("float").alias("value")).write.format(EventFiles.name()).mode("append").save(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(EventFiles)
    return spark.read.format(EventFiles.name()).load(path)
