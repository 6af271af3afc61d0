"""Operator 10: WARC archives, their gzip normaliser and their reader.

``write_archives`` writes pages as WARC records into archives of one gzip stream each (the "monolithic" form that cannot be
read from the middle). ``normalise`` inflates each of these once, front to back, rewrites every record as a gzip member of its
own and puts an index of (offset, length, record id) beside it. ``read_archives`` seeks to each member by that index.

Memory holds one record and one read block, whatever the archive's size. Files go under a folder all executors share, by
pyarrow's file systems; a file is written under the task attempt's own name and then renamed, so a task that runs again
replaces its file. Hot payloads: the first page of a payload comes from an aggregate on the digest that combines in each task
before the shuffle, and the join back to the pages is one that Spark can split.

Defined cases: a null html is an empty payload; a null url is written as ``-``; a null page_id is written as ``-``, sorts after
all others and is read back as null; equal (page_id, html) rows are all kept; line ends in a url are percent-encoded; an empty
table makes no archives and no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, bounded, filesystem, new_folder, through_table

#: Payloads shorter than this are never revisits.
LEAST = 100
#: An archive is closed after so many payload bytes.
ROLL = 64 << 20
READ = 1 << 20
FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])
INDEXED = pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "-").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file that appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        ctx = TaskContext.get()
        self.part = f"{self.path}.{ctx.taskAttemptId() if ctx else 0}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_archives(pages: DataFrame, folder: str, level: int = 3, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes page_id, url, html as archives under folder, and returns a table of (path, records)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= least
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(first, "digest", "left").withColumn("revisit", long & F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, size, n, packer = TaskContext.get().partitionId(), 0, None, 0, 0, None
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            for page_id, url, html, digest, first_id, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id", "revisit")), strict=True):
                if out is None:
                    uri = f"{folder}/raw/{part:06d}-{seq:04d}.warc.gz"
                    out, size, n, packer = _File(uri), 0, 0, zlib.compressobj(level, wbits=31)
                payload = html.encode()
                out.write(packer.compress(record(page_id, url, payload, digest, first_id, revisit)))
                size, n = size + len(payload), n + 1
                if size >= roll:
                    out.write(packer.flush())
                    out.close()
                    yield batch(FILES, [[uri], [n]])
                    out, seq = None, seq + 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield batch(FILES, [[uri], [n]])

    return through_table(rows.select("page_id", "url", "html", "digest", "first_id", "revisit").mapInArrow(write, "path string, records long"), "warc-raw")


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or more, read once."""
    unpack = zlib.decompressobj(wbits=31)
    while data := source.read(READ):
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(wbits=31)
            else:
                break
    yield unpack.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, block, whole record) for each record of a WARC byte stream."""
    have = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        if piece:
            have.extend(piece)
        return not ended

    while True:
        while (at := have.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if bytes(have).strip():
                raise ValueError("the archive ends inside a record's header")
            return
        lines = bytes(have[:at]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(fields["content-length"])
        while len(have) < end + 4 and more():
            pass
        if len(have) < end + 4:
            raise ValueError("the archive ends inside a record's block")
        yield fields, bytes(have[at + 4 : end]), bytes(have[: end + 4])
        del have[: end + 4]


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Each archive of (path) rewritten as one gzip member a record, with an index beside it: a table of (path, index, records)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = filesystem(path)
                name = f"{folder}/norm/{path.rpartition('/')[2]}"
                out, index, offset, n = _File(name), _File(f"{name}.idx"), 0, 0
                with fs.open_input_stream(at, compression=None) as source:
                    for fields, _, whole in split_records(inflate(source)):
                        packer = zlib.compressobj(level, wbits=31)
                        member = packer.compress(whole) + packer.flush()
                        out.write(member)
                        index.write(f"{offset} {len(member)} {fields['warc-record-id']}\n".encode())
                        offset, n = offset + len(member), n + 1
                out.close()
                index.close()
                yield batch(INDEXED, [[name], [f"{name}.idx"], [n]])

    spread = archives.select("path").repartition(max(1, archives.count()))
    return through_table(spread.mapInArrow(rewrite, "path string, index string, records long"), "warc-norm")


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """One row of RECORDS; the digest and size of a response are taken from its payload, those of a revisit from its header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        n = next(int(v) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")) if k.lower() == "content-length")
    else:
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != fields["warc-payload-digest"].removeprefix("sha256:"):
            raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return _page(fields["warc-record-id"]), n, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each read at its offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_stream(filesystem(index)[1], compression=None) as f:
                    entries = [x.split(b" ", 2)[:2] for x in f.read().splitlines()]
                rows = []
                with fs.open_input_file(at) as source:
                    for offset, length in entries:
                        whole = zlib.decompress(source.read_at(int(length), int(offset)), wbits=31)
                        rows.append(parse(*next(split_records(iter([whole])))[:2]))
                        if len(rows) == 10_000:
                            yield batch(RECORDS, list(zip(*rows, strict=True)))
                            rows = []
                if rows:
                    yield batch(RECORDS, list(zip(*rows, strict=True)))

    return archives.select("path", "index").repartition(max(1, archives.count())).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    raw = write_archives(bounded(spark).read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(normalise(raw, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
