"""Web archives: written as one gzip stream each, normalised, indexed, read back.

:func:`write_archives` writes a record per page. Pages with equal payloads of at
least ``min_bytes`` become one response and revisits that refer to it. Each task
writes whole archives as single gzip streams, as many crawlers leave them: such a
file can only be read from its start. :func:`normalise` inflates every archive
once, in a stream, rewrites each record as a gzip member of its own and writes a
sidecar index of offsets, so that any record can then be read by itself.
:func:`read_records` does that for a whole index.

Files go to a folder that all nodes share (any scheme that Arrow opens). A file
name is new for every attempt of a task and only files that a finished task
reported are in the listings, so a lost executor leaves at most files that nobody
reads. Each archive is a task's own. Memory holds one record and a slice of the index.

Defined results: a null payload is empty. Smaller payloads, and all rows that
have the group's smallest id, are responses; rows of a null id can only refer,
unless all ids of the group are null. A null or empty url is left out of the
record; control characters in it are percent-encoded. Other columns do not
matter. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import as_batch, importable, staged, work_folder

#: Bytes of records after which a task begins another archive.
ROLL = 256 << 20
LEVEL = 4
#: Index entries that are held before they leave a task.
ENTRIES = 4096
#: Bytes of members that one task reads back, and the most tasks of a job.
READ_BYTES, MOST_TASKS = 16 << 20, 50_000
STEP = 1 << 20
#: What a revisit of an identical payload is called.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the date of records whose capture time is not known.
DATE = "1970-01-01T00:00:00Z"

INDEX = (
    "archive string, offset long, length long, record_type string, page string,"
    " target string, digest string"
)


def opened(path: str):
    system, local = fs.FileSystem.from_uri(path)
    return system, local


def pages_with_links(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int
) -> DataFrame:
    """``id, url, payload, digest, refers_to``.

    Only repeated digests are joined, from a table whose size the planner knows:
    it is broadcast if below the session's threshold.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("same", "first")
    )
    linked = rows.join(staged(repeated), F.col("digest") == F.col("same"), "left")
    other = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return linked.select("id", "url", "payload", "digest", other.alias("refers_to"))


def record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    def name(i) -> str:
        return f"<urn:page:{'' if i is None else i}>"

    block = HTTP_HEAD + (b"" if refers_to is not None else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    if refers_to is not None:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {name(refers_to)}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """One gzip stream over all its records."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, local = opened(self.path)
        system.create_dir(local.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(local, compression=None)
        self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.records = self.size = 0

    def add(self, data: bytes) -> None:
        self.file.write(self.gzip.compress(data))
        self.records, self.size = self.records + 1, self.size + len(data)

    def close(self) -> tuple[str, int]:
        self.file.write(self.gzip.flush())
        self.file.close()
        return self.path, self.records


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    *,
    min_bytes: int = 100,
    roll: int = ROLL,
) -> DataFrame:
    """Write the archives; a listing ``archive, records`` of them."""
    spark = pages.sparkSession
    folder = f"{folder or work_folder(spark)}/crawl"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for row in zip(*batch.columns):
                if archive is None:
                    archive = Archive(folder)
                archive.add(record(*(v.as_py() for v in row)))
                if archive.size >= roll:
                    yield as_batch([archive.close()], LISTING)
                    archive = None
        if archive is not None:
            yield as_batch([archive.close()], LISTING)

    rows = pages_with_links(pages, id_col, url_col, payload_col, min_bytes)
    return staged(importable(rows).mapInArrow(run, "archive string, records long"))


LISTING = pa.schema([("archive", pa.string()), ("records", pa.int64())])


class Inflated:
    """Bytes of a gzip file of any number of members, as asked for."""

    def __init__(self, stream):
        self.stream, self.data = stream, bytearray()
        self.gzip, self.rest = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        raw = self.rest or self.stream.read(STEP)
        if not raw:
            return False
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        self.data += self.gzip.decompress(raw, STEP)
        self.rest = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        at, seen = self.data.find(mark), 0
        while at < 0:
            seen = max(0, len(self.data) - len(mark))
            if not self._more():
                return None
            at = self.data.find(mark, seen)
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise EOFError(f"{n - len(self.data)} bytes are missing")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (lower-case names), block and raw bytes of each record."""
    data = Inflated(stream)
    while (head := data.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        block = data.take(int(fields["content-length"]))
        yield fields, block, head + block + data.take(4)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def page_of(name: str | None) -> str | None:
    return (name or "").removeprefix("<urn:page:").removesuffix(">") or None


def normalise(listing: DataFrame, folder: str | None = None) -> DataFrame:
    """One gzip member per record, and the index of all members."""
    folder = f"{folder or work_folder(listing.sparkSession)}/normal"
    schema = pa.schema(
        [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
        + [(c, pa.string()) for c in ("record_type", "page", "target", "digest")]
    )

    def rewrite(path: str) -> Iterator[list[tuple]]:
        system, local = opened(path)
        new = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        out_system, out_local = opened(new)
        out_system.create_dir(out_local.rpartition("/")[0], recursive=True)
        entries, offset = [], 0
        with (
            system.open_input_stream(local, compression=None) as source,
            out_system.open_output_stream(out_local, compression=None) as out,
            out_system.open_output_stream(f"{out_local}.idx", compression=None) as sidecar,
        ):
            for fields, _, raw in records(source):
                gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = gzip.compress(raw) + gzip.flush()
                out.write(member)
                entry = (
                    new,
                    offset,
                    len(member),
                    fields.get("warc-type"),
                    page_of(fields.get("warc-record-id")),
                    fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest"),
                )
                sidecar.write(json.dumps(dict(zip(schema.names[1:], entry[1:]))).encode() + b"\n")
                entries.append(entry)
                offset += len(member)
                if len(entries) >= ENTRIES:
                    yield entries
                    entries = []
        yield entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for entries in rewrite(path):
                    yield as_batch(entries, schema)

    # One archive is one unit of work: a single gzip stream cannot be split. The
    # listing is tiny, so the number of tasks is given; Spark would merge them.
    dealt = dealt_out(listing.select("archive"), listing.count(), "archive")
    return staged(importable(dealt).mapInArrow(run, INDEX))


def dealt_out(rows: DataFrame, tasks: int, *by: str) -> DataFrame:
    """``rows`` in ``tasks`` ranges, in order; never merged by adaptive execution."""
    return rows.repartitionByRange(max(1, min(tasks, MOST_TASKS)), *by).sortWithinPartitions(*by)


def read_records(index: DataFrame, key: str = "long") -> DataFrame:
    """Every record of the index, each read by its offset alone.

    ``page, record_type, payload, payload_bytes, digest, refers_to``; digest and
    length of a revisit are those its record states for the full payload. Payloads
    of responses are digested anew: a record that does not match fails the job.
    """
    import hashlib

    def parse(member: bytes) -> tuple:
        raw = zlib.decompress(member, 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = headers(head + b"\r\n\r\n")
        block = rest[: int(fields["content-length"])]
        payload = block.partition(b"\r\n\r\n")[2]
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        page, kind = page_of(fields["warc-record-id"]), fields["warc-type"]
        if kind == "revisit":
            other = page_of(fields["warc-refers-to"])
            return page, kind, None, int(fields["x-payload-length"]), stated, other
        if (digest := hashlib.sha256(payload).hexdigest()) != stated:
            raise ValueError(f"record of page {page} has another payload than its digest says")
        return page, kind, payload, len(payload), digest, None

    out = pa.schema(
        [
            ("page", pa.string()),
            ("record_type", pa.string()),
            ("payload", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("digest", pa.string()),
            ("refers_to", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            rows: list[tuple] = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != path:
                    if file is not None:
                        file.close()
                    system, local = opened(archive)
                    path, file = archive, system.open_input_file(local)
                file.seek(offset)
                rows.append(parse(file.read(length)))
                if len(rows) >= 256:
                    yield as_batch(rows, out)
                    rows = []
            if rows:
                yield as_batch(rows, out)
        if file is not None:
            file.close()

    places = index.select("archive", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = dealt_out(places, -(-total // READ_BYTES), "archive", "offset")
    read = importable(dealt).mapInArrow(
        run,
        "page string, record_type string, payload binary, payload_bytes long,"
        " digest string, refers_to string",
    )
    return read.withColumns({c: F.col(c).cast(key) for c in ("page", "refers_to")})
