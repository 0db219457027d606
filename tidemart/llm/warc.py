"""Web archives of individually compressed records that share an embedded dictionary (operator 2)."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm.among import parted
from tidemart.session import scratch_dir, settle

DICTIONARY_FRAME = 0x184D2A5D  # magic number of the skippable frame that holds the dictionary
MIN_REVISIT = 1000
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 4 << 20  # records of an archive that its dictionary is built from: the first ones, whole
ARCHIVE_BYTES = 256 << 20  # an archive is closed when it holds this many bytes before compression
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # fixed, so that writing again gives the same bytes
NAMES = uuid.UUID("6f1d3c7e-2a54-4c1c-9f6e-5a1f0f5b7a10")

MANIFEST = "archive string, records long, bytes long"
RECORD = ("archive string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long")


# -- one archive ------------------------------------------------------------------------------

def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no block; extension fields carry the page ids and the full payload's length."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        # a header line ends at a line break, so control characters and % are escaped
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if first != "WARC/1.1" or len(rest) != int(fields["Content-Length"]) + 4:
        raise ValueError(f"not a whole WARC record: {first[:40]}")
    return fields, rest[:-4]


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of too few or too even ones, their bytes as a raw dictionary."""
    total = sum(map(len, samples))
    if len(samples) >= 8 and total >= 8 * 1024:
        try:
            size = min(DICTIONARY_BYTES, max(1024, total // 8))
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Archive:
    """Writes one archive. Nothing reaches the file before the dictionary is there; after that each record does."""

    def __init__(self, open_file: Callable[[], io.IOBase]):
        self.open_file, self.out = open_file, None
        self.waiting: list[bytes] = []
        self.size = self.records = self.raw = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.out is not None:
            self._write(record)
            return
        self.waiting.append(record)
        if self.raw >= TRAIN_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = train(self.waiting)
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_content_size=True, write_checksum=True)
        self.out = self.open_file()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        for record in self.waiting:
            self._write(record)
        self.waiting = []

    def _write(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            self._start()
        self.out.close()


def read_archive(stream: io.IOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, one at a time."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    dictionary = _exactly(stream, size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held, frame = b"", None
    out: list[bytes] = []
    while True:
        data = held or stream.read(1 << 20)
        held = b""
        if not data:
            break
        if frame is None:
            frame, out = reader.decompressobj(), []
        out.append(frame.decompress(data))
        if frame.eof:
            held, frame = frame.unused_data, None
            yield parse_record(b"".join(out))
    if frame is not None:
        raise ValueError("the last record is cut short")


def _exactly(stream: io.IOBase, n: int) -> bytes:
    parts = []
    while n:
        part = stream.read(n)
        if not part:
            raise ValueError("the archive is cut short")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


# -- Spark ------------------------------------------------------------------------------------

def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as executors reach it: local and mounted folders, s3 (also written s3a) and gs as they
    are; hdfs needs libhdfs on the executors."""
    path = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null: a response).

    Payloads of at least ``min_bytes`` bytes with equal digests: the largest page_id is the response, others refer to it.
    Rows that repeat that page_id are responses too. A null page_id counts as smaller than all; a group without any
    page_id is all responses. Rows whose digest is surely not repeated pass beside the join, which moves the payload of
    the others' rows: its small side has one row per repeated digest, so Spark can cut a digest that holds a third of
    the rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    long = F.length("payload") >= min_bytes
    narrow = settle(
        rows.filter(long).groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and response is not null").drop("n"), "warc-groups")
    maybe, others = parted(rows, narrow, ("payload_digest",))
    joined = maybe.join(narrow, "payload_digest", "left").select(*rows.columns, "response").unionByName(
        others.withColumn("response", F.lit(None).cast("long")))
    refers = F.when(long & (F.col("page_id").isNull() | (F.col("page_id") != F.col("response"))), F.col("response"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``plan_records`` to archives below ``folder``; the manifest names the finished ones.

    Each task writes archives of its own with names that no other attempt has. Only archives in the manifest, which
    Spark commits once per task, count: what a lost or repeated attempt left is never read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        archive, name = None, ""

        def done() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [name], "records": [archive.records], "bytes": [archive.size]})

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c))
                       for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[row].as_py() for c in columns)
                if archive is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(lambda: store.open_output_stream(name, compression=None))
                archive.add(record_bytes(page_id, url, payload, digest, refers_to))
                if archive.raw >= ARCHIVE_BYTES:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    return settle(records.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest``, checked against its digest.

    payload is null for revisits (and for all with ``payloads=False``); ``resolve`` finds it.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, block in read_archive(stream):
                        rows.append(_row(name, fields, block, payloads))
                        held += len(block) if payloads else 200
                        if held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = manifest.select("archive").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, RECORD)


def _row(name: str, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
        raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    url = fields.get("WARC-Target-URI")
    if url is not None and "%" in url:
        head, *rest = url.split("%")
        url = head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)
    return (name, number("X-Page-Id"), url, block if payloads and kind == "response" else None,
            len(block) if kind == "response" else number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id"))


_TYPES = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the payload of each revisit taken from its response."""
    found = (
        records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"))
        .agg(F.first("payload").alias("_payload"))
    )
    on = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    return records.join(found, on, "left").withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_digest", "_payload")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html), then read all archives back.

    A null html is an empty payload; a null url or page_id leaves its header out and comes back as null; an empty table
    gives no archive and no rows. Extra columns of ``pages`` are not read. Texts of any length are one record each.
    """
    folder = folder or scratch_dir(spark, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder, payloads)
