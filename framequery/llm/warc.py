"""WARC archives of zstd frames with a shared dictionary, written and read with Spark.

Layout of an archive: a leading skippable frame (magic 0x184D2A5D) holds the
dictionary; then each record is one zstd frame compressed with it. Between frames
stand empty skippable frames, which every zstd reader passes over: they are the line
separator of Spark's text writer, so archives go to any file system through Spark's
own committer, and a task that is run again replaces its file.

The dictionary is trained on at most ``SAMPLE_ROWS`` payload heads of ``SAMPLE_BYTES``.

Reading loads the dictionary, walks the frames by their block headers, decodes one
frame per record and checks version line, required headers, Content-Length, record
end and the payload digest. A record that fails gives a row whose ``error`` says why
(or raises, with ``strict``), and the reader goes on with the next frame.

Defined cases: null html is an empty payload; equal payloads are those with equal
SHA-1 digests and lengths; rows that tie for the largest page_id of a payload (repeated rows) are all
responses; a null page_id counts as smaller than any other; extra columns are ignored;
an empty table gives no records. A writer task makes one archive of its split, so
spark.sql.files.maxPartitionBytes bounds the archive that one reader task holds.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import cut, delete_on_exit, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can part lines of text.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 << 10
LEVEL = 3
#: Digests of repeated payloads are broadcast up to so many (28 bytes each).
BROADCAST_DIGESTS = 200_000
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_ID = "urn:page:"


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), record_type and refers_to of every page.

    Of equal payloads of at least ``min_bytes`` the row with the largest page_id is the
    response. Payloads are grouped by digest with partial aggregation, and only digests
    that occur more than once are joined back: by broadcast up to BROADCAST_DIGESTS of
    them, so that payloads stay where they are, else by a shuffle that AQE can split.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    groups = cut(
        rows.where(F.col("size") >= min_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "size", "keeper")
    )
    if groups.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        groups = F.broadcast(groups)
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(groups, ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to")
    )


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record(page_id, url, payload: bytes, digest: bytes, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else page_id
    heads = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{base32_digest(digest)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(heads).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payload heads; empty if there is too little text."""
    n = pages.count()
    part = min(1.0, 1.5 * SAMPLE_ROWS / max(1, n))
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(part * (1 << 30))
    heads = pages.where(F.col("html").isNotNull() & draw).select(F.substring("html", 1, SAMPLE_BYTES).alias("head")).limit(SAMPLE_ROWS)
    samples = [r["head"].encode("utf-8") for r in heads.collect()]
    samples = [s for s in samples if s]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(classified: DataFrame, dictionary: bytes, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one archive per partition of ``classified`` under ``path``."""
    raw = F.unhex(F.lit("00FF80FEC328"))
    if not classified.sparkSession.range(1).select(raw.cast("string").cast("binary") == raw).first()[0]:
        raise RuntimeError("archives go through the text writer, which needs bytes to pass a cast to string as they are")
    held = classified.sparkSession.sparkContext.broadcast(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = zstandard.ZstdCompressionDict(held.value) if held.value else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=word, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(held.value)) + held.value
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for row in range(batch.num_rows):
                values = [c[row].as_py() for c in columns]
                frame = packer.compress(record(*values, date))
                yield pa.RecordBatch.from_arrays([pa.array([lead + frame], pa.binary())], names=["value"])
                lead = b""

    raw = classified.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(frames, "value binary")
    raw.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame at ``at`` ends, by its header and block headers (RFC 8878)."""
    start, n = at, len(data)

    def need(k: int) -> None:
        if at + k > n:
            raise ValueError(f"frame at {start} is cut off")

    need(5)
    flags = data[at + 4]
    at += 5
    single = flags >> 5 & 1
    at += (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        need(3)
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3
        size = 1 if head >> 1 & 3 == 1 else head >> 3
        need(size)
        at += size
        if head & 1:
            break
    if flags >> 2 & 1:
        need(4)
        at += 4
    return at


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of an archive; a bad record has ``error`` set."""
    data, at, opener, first = memoryview(content), 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            yield {"error": f"{len(data) - at} bytes left over at {at}"}
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                yield {"error": f"skippable frame at {at} is cut off"}
                return
            if magic == DICTIONARY_MAGIC and first and size:
                word = bytes(data[at + 8 : at + 8 + size])
                if struct.unpack_from("<I", word)[0] == FRAME_MAGIC:  # a compressed dictionary
                    word = zstandard.ZstdDecompressor().decompress(word, max_output_size=1 << 28)
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(word))
            at, first = at + 8 + size, False
            continue
        first = False
        if magic != FRAME_MAGIC:
            yield {"error": f"no frame at {at}"}
            return
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield {"error": str(e)}
            return
        try:
            out = opener.decompressobj().decompress(bytes(data[at:end]))
            yield parse_record(out)
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": f"record at {at}: {e}"}
        at = end


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ValueError names what is wrong with it."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        if name not in fields:
            raise ValueError(f"no {name}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit {len(rest)} bytes")
    block, kind = rest[:-4], fields["warc-type"]
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP headers")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if sizes != [len(payload)]:
            raise ValueError("HTTP length does not fit the payload")
        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii"):
            raise ValueError("payload digest does not fit")
    elif kind != "revisit":
        raise ValueError(f"unknown type {kind}")
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(_ID)).lstrip("-").isdigit() else None
    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": sizes[0] if sizes else None,
        "payload": payload if kind == "response" else None,
        "error": None,
    }


_FIELDS = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_digest": "string", "payload_bytes": "long", "payload": "binary", "error": "string"}


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """The records of all archives under ``path``, by way of Spark's binary file source."""
    columns = list(_FIELDS) if columns is None else columns
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for row in read_archive(content.as_py()):
                    if strict and row["error"]:
                        raise ValueError(row["error"])
                    rows.append(row)
                    held += len(row.get("payload") or b"") if "payload" in columns else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[_FIELDS[c]]) for c in columns], names=columns)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(read, ", ".join(f"{c} {_FIELDS[c]}" for c in columns))


def archive(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write all pages as archives in the shared folder, one per input split; returns their path.

    They last as long as the session; ``write_archives`` keeps archives where it is told.
    """
    path = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(classify(pages, min_bytes), train_dictionary(pages), path)
    delete_on_exit(pages.sparkSession, path)
    return path
