"""WARC archives: a writer with payload deduplication, and a sequential reader.

Every record is one gzip member. The reader takes an archive front to back: it inflates a member piece by piece through
an incremental decompressor fed with blocks of the file, reads the header, then exactly as many bytes as its Content-Length says,
and checks the block and payload digests. A torn or altered record raises ``WarcError``.

Archives are opened through ``pyarrow.fs`` from the URI of the shared folder, so the same code works on a local, an
HDFS or an object store. A writing task names its files by itself and an attempt's random suffix; only those in the
returned manifest count, so a repeated or lost task leaves no record twice.

Defined cases: a null html is an empty payload, a null url an empty URI; of equal payloads of 100 bytes and more, every
row with the smallest page_id is a response (repeated rows are each written); rows with a null page_id are responses
only if their group has no other; extra columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk.llm._work import new_folder, written

LEAST_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
BLOCK = 1 << 20
HEADER = 1 << 20  # bytes that a record's header may have
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that can't be framed or whose digests don't match."""


def record_bytes(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed. A revisit has the HTTP header only; its payload digest is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Members:
    """The gzip members of a stream of blocks, inflated piece by piece, one member after another."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.rest = blocks, b""
        self.z, self.held = None, bytearray()

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the stream."""
        while not self.rest:
            if (block := next(self.blocks, None)) is None:
                return False
            self.rest = block
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Inflates up to ``BLOCK`` bytes more; False at the member's end."""
        while not self.z.eof:
            try:
                out = self.z.decompress(self.rest, BLOCK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                self.held += out
                return True
            if not self.z.eof and not self.rest:
                if (block := next(self.blocks, None)) is None:
                    raise WarcError("the archive ends within a member")
                self.rest = block
        return False

    def until(self, mark: bytes) -> bytes:
        """What stands before ``mark``, which goes too."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > HEADER or not self._more():
                raise WarcError("no WARC header")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise WarcError("the record is shorter than its Content-Length says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self) -> None:
        if self.held or self._more():
            raise WarcError("the record is longer than its Content-Length says")


def framed(member: _Members) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a member's record: the header first, then as many bytes as it says."""
    lines = member.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = member.exactly(n)
    if member.exactly(4) != b"\r\n\r\n":
        raise WarcError("the record doesn't end where its Content-Length says")
    member.end()
    if (want := fields.get("warc-block-digest")) and want != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError(f"block digest of {fields.get('warc-record-id')}")
    return fields, block


def payload_length(block: bytes) -> int | None:
    """The Content-Length of an HTTP header: a revisit has it for the payload that it leaves out."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int | None]]:
    """(header fields, payload, length of the full payload) of each record; a response's payload digest is checked."""
    member = _Members(blocks)
    while member.begin():
        fields, block = framed(member)
        http = fields.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise WarcError(f"payload digest of {fields.get('warc-record-id')}")
        yield fields, payload, payload_length(block) if http and fields.get("warc-type") == "revisit" else len(payload)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row ``page_id, url, html``; returns the manifest ``path, records, bytes``."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Digests that occur once need no join partner; only groups of copies are kept on the small side.
    first = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # As a table of its own: a join straight on an aggregate can't have its hot keys split.
    first = written(first, "first-copies")
    # Pages are dealt by digest whatever the size of the other side, so what runs on small tables is what runs on large ones.
    rows = rows.join(first.hint("merge"), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                data = member(record_bytes("response" if refers_to is None else "revisit", page_id, url, html.encode(), digest, refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return written(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in ``manifest.path``: ids, digest, type and length of the full payload."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def blocks(path: str) -> Iterator[bytes]:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as f:
                while block := f.read(BLOCK):
                    yield block

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, n, held = [], 0, 0
                for fields, payload, length in records(blocks(path)):
                    kind = fields.get("warc-type", "")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                    found.append((number("x-page-id"), fields.get("warc-target-uri"), length, fields.get("warc-payload-digest", "").removeprefix("sha256:"), kind, number("x-refers-to-page-id"), *[payload] * with_payload))
                    n, held = n + 1, held + with_payload * len(payload)
                    if len(found) >= 4096 or held > 16 << 20:
                        yield batch(found)
                        found, held = [], 0
                if n != count:
                    raise WarcError(f"{path} holds {n} records; {count} were written")
                if found:
                    yield batch(found)

    # An archive a task: the manifest is a few rows.
    paths = manifest.select("path", "records").repartition(max(1, min(10_000, spark.sparkContext.defaultParallelism * 4)), "path")
    return paths.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes and reads back: everything in the report comes from the records."""
    back = read_archives(write_archives(pages))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
