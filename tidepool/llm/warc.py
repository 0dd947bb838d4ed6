"""Web archives in seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: WARC records grouped into independent Zstandard frames, and in a skippable frame at its end a seek table with the
sizes and checksums of all frames. Any Zstandard reader can read it from the start; with the table one frame can be read
alone. Writing gives an index from record identifiers to bundle, frame, and offset and length within the frame.

A payload that many pages have in common is stored once, as a response; the others are revisits that name it. Groups of equal payloads
are reduced in shares, so that none goes through one task. Pages move only if the table of revisits is too large to send to all tasks.

Bundles are files of the folder that driver and executors share (or one that is given), written through Arrow's file systems. The name of a
file is new for each attempt of a task, and the index names only files of attempts that were committed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken
from tidepool.llm.groups import salt, share_totals
from tidepool.llm.scratch import cut, scratch_path

#: Bytes of a payload from which on repeats are stored as revisits; of records in a frame before a new one begins; of a bundle, likewise.
LEAST, FRAME, BUNDLE = 1000, 1 << 20, 64 << 20
#: Zstandard's level, and the most tasks that read bundles.
LEVEL, TASKS = 3, 10_000

# Fixed values of the seekable format: magic number of the skippable frame that holds the table, magic number at its end, descriptor with checksums.
TABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

# Fixed values of the archive format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_type string, refers_to long, bundle string, frame int, start long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with the HTTP headers of its payload; a revisit has those headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


@dataclass
class Record:
    """A record as read: its headers, those of the HTTP message, and the payload that is there (none in a revisit)."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]

    @property
    def url(self) -> str | None:
        held = self.headers.get("WARC-Target-URI")
        return held and held.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")

    def row(self) -> tuple:
        """As ``RECORDS``; the digest of a payload that is there is taken of its bytes, and must be what the header says."""
        digest = self.headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if self.kind == "response" and (hashlib.sha1(self.payload).hexdigest() != digest or len(self.payload) != int(self.http["Content-Length"])):
            raise ValueError(f"record {self.headers['WARC-Record-ID']} holds another payload than it says")
        return page_of(self.headers["WARC-Record-ID"]), self.url, int(self.http["Content-Length"]), digest, self.kind, page_of(self.headers.get("WARC-Refers-To"))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines)


def records_of(data: bytes, at: int = 0) -> Iterator[Record]:
    """The records that stand one after another in the bytes of a frame."""
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at {at}")
        body = data.index(END, at) + len(END)
        headers = _headers(data[at : body - len(END)])
        end = body + int(headers["Content-Length"])
        inner = data.index(END, body, end) + len(END)
        if data[end : end + len(END)] != END:
            raise ValueError(f"the record at {at} does not end at {end}")
        yield Record(headers, _headers(data[body : inner - len(END)]), data[inner:end])
        at = end + len(END)


@dataclass
class Writer:
    """Writes records into the frames of one file at a time, and a new file beyond ``bundle`` bytes."""

    folder: str
    frame: int = FRAME
    bundle: int = BUNDLE
    _out: pa.NativeFile | None = None
    _name: str = ""
    _held: list[bytes] = field(default_factory=list)
    _bytes: int = 0
    _table: list[tuple[int, int, int]] = field(default_factory=list)
    _written: int = 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """Where the record will be: bundle, frame, and offset in the frame."""
        if self._out is None:
            files, root = pafs.FileSystem.from_uri(self.folder)
            files.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            self._out, self._name, self._table, self._written = files.open_output_stream(f"{root}/{name}", compression=None), f"{self.folder}/{name}", [], 0
        place = self._name, len(self._table), self._bytes
        self._held.append(raw)
        self._bytes += len(raw)
        if self._bytes >= self.frame:
            self._end_frame()
            if self._written >= self.bundle:
                self.close()
        return place

    def _end_frame(self) -> None:
        data = b"".join(self._held)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(data)
        self._out.write(packed)
        self._table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._held, self._bytes, self._written = [], 0, self._written + len(packed)

    def close(self) -> None:
        if self._out is None:
            return
        if self._held:
            self._end_frame()
        entries = b"".join(ENTRY.pack(*e) for e in self._table)
        footer = FOOTER.pack(len(self._table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self._out.close()
        self._out = None


class Bundle:
    """A bundle open for reading: its seek table, and any of its frames."""

    def __init__(self, path: str):
        files, place = pafs.FileSystem.from_uri(path)
        self._file = files.open_input_file(place)
        size = self._file.size()
        count, descriptor, magic = FOOTER.unpack(self._file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or descriptor != WITH_CHECKSUMS:
            raise ValueError(f"{path} ends in no seek table")
        raw = self._file.read_at(count * ENTRY.size, size - FOOTER.size - count * ENTRY.size)
        self.table = list(ENTRY.iter_unpack(raw))
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def frame(self, k: int) -> bytes:
        packed, length, checksum = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(self._file.read_at(packed, self.starts[k]), max_output_size=length)
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not hold what the seek table says")
        return data


def revisits(pages: DataFrame, least: int = LEAST, html: str = "html", id_column: str = "page_id") -> DataFrame:
    """(digest, mark, salt, last): for the shares of each payload of at least ``least`` bytes that several pages have, the largest id among them."""
    own = taken(pages, page_id=id_column, html=html).select("page_id", utf8("html").alias("payload")).where(F.octet_length("payload") >= least)
    keyed = own.select("page_id", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("mark"), salt("page_id").alias("salt"))
    share = [F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")]
    total = [F.max("last").alias("last"), F.sum("copies").alias("copies")]
    return share_totals(keyed, ["digest", "mark"], share, total, "copies > 1 AND last IS NOT NULL").drop("copies")


def _writing(folder: str, frame: int, bundle: int, date: str):
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, frame, bundle)
        for batch in slices(batches, 2):
            rows = []
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page_id, url, payload, digest, refers, date)
                rows.append((page_id, "response" if refers is None else "revisit", refers, *writer.add(raw), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        writer.close()

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page into bundles under ``folder`` (a new one of the shared folder, unless given); the index of the records.

    Of pages with equal payloads of at least ``least`` bytes, those with the largest id are responses (several only if rows repeat that id), the others
    revisits; so are those without an id, unless no page of the payload has one. Smaller payloads are all responses. Null payloads are empty; a null URL
    gives no target. ``date`` stands for the time of capture, which the table lacks. An empty table writes no bundle. A record is never split: one that is longer than a frame is a frame.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "bundles")
    own = small_batches(taken(pages, page_id="page_id", url="url", html="html")).select(F.col("page_id").cast("long"), F.col("url").cast("string"), utf8("html").alias("payload"))
    keyed = own.select("*", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("mark"), salt("page_id").alias("salt"))
    told = keyed.join(revisits(pages, least), ["digest", "mark", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to")
    made = told.select("page_id", "url", "payload", "digest", refers).mapInArrow(_writing(folder, frame, bundle, date), INDEX)
    return cut(made, "index")


def _tasks(frame: DataFrame, many: int) -> DataFrame:
    return frame.repartition(max(1, min(many, TASKS)), "bundle")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with Bundle(path) as held:
                for k in range(len(held.table)):
                    rows = [r.row() for r in records_of(held.frame(k))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, frame by frame, with checksums and digests verified (a bad one fails the task)."""
    bundles = index.select("bundle").distinct()
    return _tasks(bundles, bundles.count()).mapInArrow(_reading, RECORDS)


def _fetching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, open_path, open_frame, held, data = [], None, None, None, b""
        for page_id, path, frame, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != open_path:
                held and held.__exit__()
                held, open_path, open_frame = Bundle(path), path, None
            if frame != open_frame:
                data, open_frame = held.frame(frame), frame
            found = next(records_of(data, start))
            found.row()
            out.append((page_id, found.url, found.payload))
        held and held.__exit__()
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["page_id", "url", "payload"])


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(page_id, url, payload binary) for the ids of ``ids`` that the index has, read by seeking: only the frames that hold them are unpacked.

    The payload of a revisit is that of the record that it names, with that record's URL. Ids repeated in ``ids`` are fetched once; an id that repeats in the index is
    fetched from one of its records.
    """
    small_batches(index)
    wanted = ids.select(F.col("page_id").cast("long")).where("page_id IS NOT NULL").distinct()
    one = index.groupBy("page_id").agg(F.min(F.struct(F.col("refers_to").isNotNull().alias("r"), "bundle", "frame", "start", "refers_to")).alias("m"))
    place = one.select("page_id", F.col("m.refers_to").alias("refers_to"), F.struct("m.bundle", "m.frame", "m.start").alias("at"))
    direct = wanted.join(place, "page_id")
    stored = place.where("refers_to IS NULL").select(F.col("page_id").alias("refers_to"), F.col("at").alias("stored"))
    found = direct.join(stored, "refers_to", "left").select("page_id", F.coalesce("stored", "at").alias("at")).select("page_id", "at.*")
    found = cut(found, "wanted")
    bundles = found.select("bundle").distinct().count()
    return _tasks(found, bundles).sortWithinPartitions("bundle", "frame", "start").mapInArrow(_fetching, "page_id long, url string, payload binary")
