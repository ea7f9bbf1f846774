"""WARC archives: a writer of gzip members by partition, and a splittable reader.

Writer: payload digests are counted per digest before they are shuffled, and only digests that occur with two or more
ids are joined back: broadcast while they are at most ``BROADCAST_DIGESTS``, else as a shuffled join with a salted key,
so that copies which make up a third of all rows don't meet in one task. Each task writes one file, a gzip member a
record, under a name of its own attempt, and reports it; files of failed attempts are never reported, so never read.

Reader: a task takes a byte range of a file and owns the records that start inside it. It scans for the gzip magic, and
takes a candidate only if it decodes to a WARC header and ends where another member, or the file, begins or ends. From
there members follow each other; after a broken one it scans on.

Defined results: a null payload is empty; rows with a null id are responses, and nothing refers to them; rows with the
same payload and the same, largest id are all responses; columns of other names are ignored; an empty table writes no
record. Payloads may hold anything, gzip members included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch, filesystem, shards_for

MAGIC = b"\x1f\x8b\x08"
FILES = "file string, records long, bytes long"
FILES_ARROW = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
#: Repeated digests of at most about 100 bytes each.
BROADCAST_DIGESTS = 100_000
ID = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", " ", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member. A revisit has no block; its digest and length are the full payload's."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = b""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, wbits=31)
    return pack.compress(data) + pack.flush()


def member(data: bytes | memoryview, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``at`` and the place after it; None if it is broken, cut, or no WARC record."""
    unpack = zlib.decompressobj(wbits=31)
    try:
        start = unpack.decompress(data[at : at + 4096], 65536)
        if not start.startswith(b"WARC/1."):
            return None
        unpack = zlib.decompressobj(wbits=31)
        out = unpack.decompress(data[at:])
    except zlib.error:
        return None
    if not unpack.eof:
        return None
    return out, len(data) - len(unpack.unused_data)


def parse(raw: bytes) -> dict[str, str | bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields: dict[str, str | bytes] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    fields["block"] = rest[: int(fields.get("content-length", 0) or 0)]
    return fields


class Window:
    """A sliding view of a file: bytes from ``base`` on, grown as members need it."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, base: int, step: int = 4 << 20):
        self.file, self.base, self.step = fs.open_input_file(path), base, step
        self.size, self.data = self.file.size(), b""

    def ended(self) -> bool:
        return self.base + len(self.data) >= self.size

    def more(self) -> bool:
        if self.ended():
            return False
        at = self.base + len(self.data)
        self.data += self.file.read_at(min(max(self.step, len(self.data)), self.size - at), at)
        return True

    def skip(self, upto: int) -> None:
        self.data, self.base = self.data[upto - self.base :], upto


def records(fs: pa.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record that starts in [start, end)."""
    w, at, sure = Window(fs, path, start), start, start == 0
    w.more()
    while at < min(end, w.size):
        if not sure:
            found = w.data.find(MAGIC, at - w.base)
            if found < 0 or w.base + found >= end:
                if w.ended() or w.base + len(w.data) >= end + 2:
                    return
                w.skip(max(at, w.base + len(w.data) - 2))
                at = w.base
                w.more()
                continue
            at = w.base + found
        if at - w.base > w.step:
            w.skip(at)
        got = member(w.data, at - w.base) if w.data[at - w.base : at - w.base + 3] == MAGIC else None
        while got is None and not w.ended() and w.data[at - w.base : at - w.base + 3] in (MAGIC, MAGIC[: len(w.data) - (at - w.base)]) and plausible(w.data, at - w.base):
            w.more()
            got = member(w.data, at - w.base)
        if got and not sure:
            while len(w.data) - got[1] < 3 and w.more():
                pass
            if (after := w.data[got[1] : got[1] + 3]) and after != MAGIC:
                got = None
        if got is None:
            at, sure = at + 1, False
            continue
        yield at, got[0]
        at, sure = w.base + got[1], True


def plausible(data: bytes, at: int) -> bool:
    """False if what is there already can't be a record, so that no more need be read for it."""
    try:
        start = zlib.decompressobj(wbits=31).decompress(data[at : at + 4096], 16)
    except zlib.error:
        return False
    return b"WARC/1."[: len(start)] == start[:7]


def payload_of(fields: dict[str, str | bytes]) -> bytes:
    return bytes(fields["block"]).partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame, scratch: Scratch, at_least: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with _refers_to: the largest id of an equal payload of at least at_least bytes, null for a response."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    sized = F.length(payload) >= at_least
    # Only what is counted is shuffled here: digest and id.
    same = pages.filter(sized).groupBy(F.sha1(payload).alias("_digest")).agg(F.max(id_col).alias("_last"), F.min(id_col).alias("_first"))
    same = scratch.save(same.filter(F.col("_last") > F.col("_first")).select("_digest", "_last"), "same")
    rows = pages.withColumn("_sha1", F.when(sized, F.sha1(payload)))
    if (n := same.count()) <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(same), F.col("_sha1") == F.col("_digest"), "left") if n else rows.withColumn("_last", F.lit(None).cast("long"))
    else:
        salts = 32
        salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("_own", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
        rows = rows.join(salted, (F.col("_sha1") == F.col("_digest")) & (F.col("_own") == F.col("_salt")), "left")
    return rows.withColumn("_refers_to", F.when(F.col(id_col) < F.col("_last"), F.col("_last")))


def write(pages: DataFrame, folder: str, at_least: int = 0, scratch: Scratch | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row; returns the files written (FILES), materialised."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    rows = decide(slim, scratch, at_least, "page_id", "payload").select("page_id", "url", "payload", "_refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None, buffer_size=1 << 20)
                out.write(record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]}, schema=FILES_ARROW)

    return scratch.save(rows.mapInArrow(run, FILES), "files")


def read(spark: SparkSession, files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of files (columns file, bytes), by byte ranges of split_bytes: offset, headers and payload facts.

    payload_bytes and payload_digest of a response are computed from what was read; of a revisit they are its headers'."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = files.filter(F.col("bytes") > 0).select("file", F.explode(starts).alias("start"))
    n = shards_for(int(files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0), 1)
    splits = splits.repartition(n, "file", "start")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_holds", pa.bool_()), ("payload", pa.binary())])

    def number(value: str) -> int | None:
        value = value.strip("<>").removeprefix(ID)
        return None if value in ("", "null") else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = filesystem(file)
                rows: list[tuple] = []
                held = 0
                for offset, raw in records(fs, path, start, start + split_bytes):
                    f = parse(raw)
                    said = str(f.get("warc-payload-digest", "")).removeprefix("sha1:")
                    if f.get("warc-type") == "revisit":
                        payload, own = None, said
                        length = int(f.get("x-payload-length", 0))
                    else:
                        payload = payload_of(f)
                        own, length = digest(payload), len(payload)
                    rows.append((file, offset, number(str(f.get("warc-record-id", ""))), f.get("warc-type"), number(str(f.get("warc-refers-to", ""))), f.get("warc-target-uri"), length, own, own == said, payload))
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return splits.mapInArrow(run, "file string, offset long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, digest_holds boolean, payload binary")


def round_trip(pages: DataFrame, at_least: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, scratch.path("archive"), at_least, scratch), split_bytes)
