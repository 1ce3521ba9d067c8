"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.llm.common import map_batches, slices, write_table
from foldsmith.storage import scratch_path

# fixed values of the seekable format: skippable frame, footer
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<record_id: string, frame: int, offset: int, length: int>>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(record_id: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP head, whose length is that of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to else b"response"), f"WARC-Record-ID: <{record_id}>".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode("utf-8", "surrogatepass"))
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}".encode(),
             b"Content-Type: application/http; msgtype=response"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: <{refers_to}>".encode()]
    return b"\r\n".join([*head, f"Content-Length: {len(block)}".encode(), b"", b""]) + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at ``at``."""
    top = data.index(b"\r\n\r\n", at)
    lines = data[at:top].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = top + 4 + int(headers["Content-Length"])
    return headers, data[top + 4:end], end + 4


class Bundle:
    """Records gathered into independent frames, closed by a footer with the frames' sizes."""

    def __init__(self, frame_bytes: int) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open, self.room, self.bytes = [], 0, 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.room, "length": len(record)})
        self.open.append(record)
        self.room += len(record)
        if self.room >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.room))
            self.frames.append(frame)
            self.bytes += len(frame)
            self.open, self.room = [], 0

    def close(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(footer)), table, footer])


def frames_of(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of every frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table = archive[len(archive) - 9 - width * count:len(archive) - 9]
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(archive: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, decompressing its frame alone."""
    start, packed, plain = frames_of(archive)[frame]
    data = zstandard.ZstdDecompressor().decompress(archive[start:start + packed], max_output_size=plain)
    return parse_record(data, offset)[:2]


def read_bundle(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records, a frame at a time."""
    opener = zstandard.ZstdDecompressor()
    for start, packed, plain in frames_of(archive):
        data, at = opener.decompress(archive[start:start + packed], max_output_size=plain), 0
        while at < len(data):
            headers, block, at = parse_record(data, at)
            yield headers, block


def record_name(page_id: int | None, url: str | None, digest: str, nth: int) -> str:
    """A name of its own for every record: page, url and payload, and a number for rows equal in all three."""
    rest = hashlib.sha1(f"{digest} {'' if url is None else '<' + url}".encode("utf-8", "surrogatepass")).hexdigest()[:20]
    return f"urn:page:{'' if page_id is None else page_id}:{rest}:{nth}"


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, size, nth, first_id, first_url, revisit): what each record is, the payload null for revisits.

    Payload digests are counted on narrow rows with map-side combining; the payloads themselves are shuffled once, by
    page_id, url and digest, so a digest that a third of the pages share is spread. Rows equal in all three are told
    apart by ``nth``.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    met = write_table(keyed.where(F.col("size") >= min_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n")), "met")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    first = met.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("n")).where("n > 1")
    first = write_table(first.select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
                        "first")
    again = write_table(met.join(first, met["digest"] == first["d"]).select(
        F.col("digest").alias("_d"), F.col("page_id").alias("_p"), F.col("url").alias("_u"), "first_id", "first_url",
        (F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))).alias("leads")), "again")
    same = Window.partitionBy("page_id", "url", "digest").orderBy(F.lit(1))
    rows = keyed.withColumn("nth", F.row_number().over(same))
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("digest") == F.col("_d")),
                       "left")
    revisit = F.col("_d").isNotNull() & ~(F.col("leads") & (F.col("nth") == 1))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", "nth", "first_id", "first_url",
                         revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 1 << 17, bundle_bytes: int = 1 << 22) -> None:
    """Write a WARC record per row of ``pages`` (page_id, url, html) as rows (bundle, archive, index) below ``folder``.

    ``archive`` is a whole .warc.zst file of about ``bundle_bytes``: independent frames of about ``frame_bytes`` of records, then the
    seek table. ``index`` maps record ids to frame and offset within it. Of records with equal payloads of at least
    ``min_bytes`` the one with the least page_id (then url; nulls last) is a response and the others revisit it. Null html is an
    empty payload, a null url has no target header, repeated rows get a record each. Other columns are ignored. A header is one line, so
    runs of white space inside a url are read back as one blank.
    """
    plan = plan_records(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes)

        def packed() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
            archive = bundle.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([archive], pa.binary()),
                                               pa.array([bundle.index], kind)], names=["bundle", "archive", "index"])

        for piece in slices(batches, 64):
            for page, url, payload, digest, size, nth, first_page, first_url, revisit in zip(*(c.to_pylist() for c in piece.columns)):
                name = record_name(page, url, digest, nth)
                bundle.add(name, make_record(name, url, payload or b"", size, base64.b32encode(bytes.fromhex(digest)).decode(),
                                             record_name(first_page, first_url, digest, 1) if revisit else None))
                if bundle.bytes >= bundle_bytes:
                    yield packed()
                    number, bundle = number + 1, Bundle(frame_bytes)
        if bundle.index:
            yield packed()

    plan.transform(map_batches, run, f"bundle string, archive binary, index {INDEX}").write.option("compression", "none").parquet(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """(record_id, page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload) of every record below ``folder``.

    Digests of responses are computed anew from the payload read and must equal the header's. ``page_id`` and ``refers_to`` are
    text, null for a record without page_id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for one in slices(batches, 1):
            rows, held = [], 0
            for headers, block in read_bundle(one.column(0)[0].as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = headers["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                name = headers["WARC-Record-ID"][1:-1]
                page = lambda urn: urn.split(":")[2] or None
                rows.append((name, page(name), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest,
                             page(headers["WARC-Refers-To"][1:-1]) if revisit else None, None if revisit else payload))
                held += len(payload)
                if held > 1 << 22:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return spark.read.schema(f"bundle string, archive binary, index {INDEX}").parquet(folder).select("archive").transform(map_batches,
        run, "record_id string, page_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, "
             "refers_to string, payload binary")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back from them.

    What nulls, empty payloads and repeated rows give is said in `write_archives`. An empty table gives no records.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes)
    return read_archives(pages.sparkSession, folder)
