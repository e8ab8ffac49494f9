"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is its frames
followed by a seek table in a skippable frame, so any frame can be read alone.
An index maps each record identifier to (bundle, frame, offset in the frame's
content, length). Bundles are rows of a table (one binary column), so Spark's
committer makes them safe against lost executors; ``export`` lets the tasks
write them as plain files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cut, few, small_batches

#: From this payload size equal payloads are stored once.
REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Fixed numbers of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed header values.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

BUNDLES = (
    "bundle string, archive binary, "
    "records array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"
)
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
FETCHED = f"record_id string, {READ}, payload binary"


def planned(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, size, ``refers_to``, ``refers_url``, and whether the row and the response are one of several equal rows.

    Of equal payloads of at least 1000 bytes the row with the largest page_id is
    the response; rows that repeat that page_id with the same payload are all
    responses. Rows without a page_id revisit nothing. The group's winner comes
    from a pre-aggregated maximum and a join that Spark may split, so a payload
    that a third of all rows share doesn't meet in one task.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("long"))
    narrow = cut(p.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("n")))
    copied = few(narrow.filter("n > 1").select(F.col("page_id").alias("i"), F.col("url").alias("u"), F.col("digest").alias("c"), F.lit(True).alias("copied")))
    best = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u"), "url", (F.col("n") > 1).alias("many"))).alias("best")
    keep = narrow.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(best, F.sum("n").alias("n")).filter("n > 1")
    keep = keep.select(F.col("digest").alias("d"), F.col("size").alias("s"), F.col("best.page_id").alias("winner"), F.col("best.url").alias("winner_url"), "best.many")
    joined = p.join(keep, (p.digest == keep.d) & (p["size"] == keep.s), "left")
    joined = joined.join(copied, F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("c")), "left")
    revisit = F.col("page_id") < F.col("winner")
    return joined.select(
        "page_id",
        "url",
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        "digest",
        "size",
        F.when(revisit, F.col("winner")).alias("refers_to"),
        F.when(revisit, F.col("winner_url")).alias("refers_url"),
        F.coalesce("many", F.lit(False)).alias("refers_many"),
        F.coalesce("copied", F.lit(False)).alias("copied"),
    )


def record_id(page_id: int | None, digest: str, url: str | None = None, copy: str = "") -> str:
    """Identifier of a page's record; rows that repeat page, url and payload differ by ``copy``."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '\x00'.join([str(page_id), digest, str(url), *[copy] * bool(copy)]))}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _packed(head: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def record(rid, page_id, url, payload, digest, size, refers_to, refers_url, refers_many) -> bytes:
    """One WARC/1.1 record: a response is an HTTP message, a revisit the HTTP head alone.

    The response of a revisit is named by page and URI, and by its record
    identifier unless several equal rows have made it.
    """
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
        if not refers_many:
            head.append(f"WARC-Refers-To: {record_id(refers_to, digest, refers_url)}")
    return _packed(head, HTTP.format(size).encode() + (bytes(payload) if payload is not None else b""))


def info_record(seed: str) -> bytes:
    """What a bundle begins with."""
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'bundle {seed}')}>"
    return _packed([f"WARC-Type: warcinfo", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"], b"software: prismalake\r\nformat: WARC File Format 1.1\r\n")


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (those of the HTTP head prefixed with ``http:``), payload and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at byte {at}")
    fields = lambda xs: dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in xs)
    head = fields(lines[1:])
    a = end + 4
    b = a + int(head["Content-Length"])
    if data[b : b + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} isn't whole")
    if head["Content-Type"].startswith("application/http"):
        inner = data.index(b"\r\n\r\n", a)
        head |= {f"http:{k}": v for k, v in fields(data[a:inner].decode().split("\r\n")[1:]).items()}
        a = inner + 4
    return head, data[a:b], b + 4


class Bundle:
    """Frames of one archive while it is written."""

    def __init__(self, seed: str) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[dict] = []
        self.open.append(info_record(seed))
        self.open_bytes = len(self.open[0])

    def add(self, rid: str, page_id: int | None, data: bytes) -> None:
        self.index.append({"record_id": rid, "page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        self.bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append((self.packer.compress(raw), len(raw)))
            self.open, self.open_bytes = [], 0

    def archive(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", len(z), n) for z, n in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*(z for z, _ in self.frames), struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the archive's end."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(archive) - 9 - n * width, []
    if struct.unpack("<II", archive[at - 8 : at]) != (SKIPPABLE, n * width + 9):
        raise ValueError("the seek table's frame is broken")
    offset = 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", archive, at + k * width)
        out.append((offset, packed, size))
        offset += packed
    return out


def read_frame(archive: bytes, frame: int) -> bytes:
    offset, packed, size = seek_table(archive)[frame]
    out = zstandard.ZstdDecompressor().decompress(archive[offset : offset + packed], max_output_size=size)
    if len(out) != size:
        raise ValueError("a frame's size differs from the seek table")
    return out


def read_record(archive: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: one frame is unpacked, whatever the archive's size."""
    return parse_record(read_frame(archive, frame), offset)[:2]


def write(pages: DataFrame) -> DataFrame:
    """Bundles (``bundle``, ``archive``, ``records``) of all pages, written to the shared folder.

    Null html is an empty payload, null page_id and url leave out their header,
    a very long html makes a frame of its own, repeated rows are records with
    identifiers of their own, an empty table has no bundles; extra columns,
    whatever their names, are ignored. A task holds one bundle at a time.
    """
    small_batches(pages.sparkSession)
    out_schema = _arrow_schema(pages.sparkSession, BUNDLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def emit(b: Bundle) -> pa.RecordBatch:
            data = b.archive()
            name = f"{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([b.index], out_schema.field(2).type)], schema=out_schema)

        task, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            for *row, copied in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                rid = record_id(row[0], row[3], row[1], f"{task}/{n}" if copied else "")
                now = now or Bundle(rid)
                now.add(rid, row[0], record(rid, *row))
                if now.bytes >= BUNDLE_BYTES:
                    yield emit(now)
                    now = None
        if now:
            yield emit(now)

    return cut(planned(pages).mapInArrow(run, BUNDLES))


def _row(head: dict[str, str], payload: bytes) -> tuple:
    """The columns of READ; a response's payload must have its digest."""
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"a wrong payload digest in {head['WARC-Record-ID']}")
    page, to, url = head.get("X-Page-ID"), head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")
    return page and int(page), None if url is None else _unline(url), int(head["http:Content-Length"]), digest, head["WARC-Type"], to and int(to)


def read(bundles: DataFrame) -> DataFrame:
    """Every record read back from the archives through their indexes; payloads of responses are verified."""
    small_batches(bundles.sparkSession)
    schema = _arrow_schema(bundles.sparkSession, READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, records in zip(b.column(0), b.column(1), strict=True):
                archive, frame, data, out = archive.as_py(), None, b"", []
                for r in records.as_py():
                    if r["frame"] != frame:
                        frame, data = r["frame"], read_frame(archive, r["frame"])
                    head, payload, end = parse_record(data, r["offset"])
                    if end - r["offset"] != r["length"] or head["WARC-Record-ID"] != r["record_id"]:
                        raise ValueError(f"the index is wrong for {r['record_id']}")
                    out.append(_row(head, payload))
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return bundles.select("archive", "records").mapInArrow(run, READ)


def index(bundles: DataFrame) -> DataFrame:
    """A row a record: identifier, page, bundle, frame, offset in the frame's content, length."""
    return bundles.select("bundle", F.inline("records")).select(*(c.split()[0] for c in INDEX.split(", ")))


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, with payload: only the frames that hold one are unpacked."""
    small_batches(bundles.sparkSession)
    schema = _arrow_schema(bundles.sparkSession, FETCHED)
    ids = few(wanted.select("record_id").distinct())
    places = index(bundles).join(ids, "record_id", "left_semi").groupBy(F.col("bundle").alias("of")).agg(F.sort_array(F.collect_list(F.struct("frame", "offset"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, places in zip(b.column(0), b.column(1), strict=True):
                archive, frame, data = archive.as_py(), None, b""
                for p in places.as_py():
                    if p["frame"] != frame:
                        frame, data = p["frame"], read_frame(archive, p["frame"])
                    head, payload, _ = parse_record(data, p["offset"])
                    row = (head["WARC-Record-ID"], *_row(head, payload), payload)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

    return bundles.join(places, F.col("bundle") == F.col("of")).select("archive", "places").mapInArrow(run, FETCHED)


def export(bundles: DataFrame, folder: str) -> int:
    """Write the bundles as files of a folder that every executor reaches by a URI or path; the number of files.

    Tasks write, none through the driver. A file is named by its content and
    takes its name when it is whole, so a task that runs again does no harm.
    """
    small_batches(bundles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            for name, archive in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(archive.as_py())
                files.move(part, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["bundle"])

    return bundles.select("bundle", "archive").mapInArrow(run, "bundle string").distinct().count()


def contract(pages: DataFrame) -> DataFrame:
    """The records read back, a row a page; ``planned`` and ``write`` define nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
