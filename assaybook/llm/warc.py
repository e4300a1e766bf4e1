"""WARC archives: a writer, and a sequential reader by incremental decompression.

An archive is a series of records, each its own gzip member. The reader feeds
compressed blocks to one zlib object at a time; where a member ends, the next
begins with the bytes left over. Within the decompressed stream a record is
framed by its header's ``Content-Length``, then two line ends. Block and
payload digests (SHA-1, base32) are computed while bytes arrive and compared.

Writing groups records by payload digest: of equal payloads the one with the
largest id is the ``response``, the others are ``revisit`` records of the
identical-payload-digest profile, which hold the HTTP header alone. Payloads
smaller than ``least_revisit`` bytes are always responses. The HTTP header of
a revisit states the length of the payload it stands for.

Defined results: a null payload is empty; a null id ranks below all others and
is written as ``urn:page:null``; repeated rows with the id of the response are
responses themselves; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import filesystem, publish, shared_dir

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_BLOCK = 1 << 18


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail not in ("", "null") else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if 33 <= ord(c) <= 126 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or page_urn(page_id))
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{page_urn(page_id)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{page_urn(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source, block: int = _BLOCK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each an iterator of decompressed parts; read each to its end before the next."""
    left = source.read(block)
    while left:
        ended = False

        def parts() -> Iterator[bytes]:
            nonlocal left, ended
            unpack = zlib.decompressobj(31)
            while not unpack.eof:
                data = left or source.read(block)
                if not data:
                    raise ValueError("the archive ends inside a gzip member")
                out = unpack.decompress(data, block)
                left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if out:
                    yield out
            ended = True

        yield parts()
        if not ended:
            raise ValueError("a gzip member was not read to its end")
        left = left or source.read(block)


class _Buffered:
    """Lines and counted bytes from an iterator of parts."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            part = next(self.parts, None)
            if part is None:
                raise ValueError("a record ends inside a header")
            self.held += part
        out, _, self.held = self.held.partition(b"\r\n")
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.parts, None) or b""
                if not self.held:
                    raise ValueError("a record is shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def rest(self) -> bytes:
        return self.held + b"".join(self.parts)


def _fields(lines: _Buffered) -> dict[str, str]:
    out = {}
    while line := lines.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(source) -> Iterator[dict]:
    """Records of an archive in order: header fields, payload (None for revisits) and what its HTTP header says."""
    for parts in members(source):
        stream = _Buffered(parts)
        version = stream.line()
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        head = _fields(stream)
        block_digest, payload_digest, body, chunks = hashlib.sha1(), hashlib.sha1(), _Buffered(iter(())), []
        length = int(head["content-length"])

        def watched(length=length, stream=stream, block_digest=block_digest):
            for part in stream.exactly(length):
                block_digest.update(part)
                yield part

        body.parts = watched()
        http_status, http = body.line(), _fields(body)
        for part in [body.held, *body.parts]:
            payload_digest.update(part)
            chunks.append(part)
        if stream.rest() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        revisit = head["warc-type"] == "revisit"
        stated = {"block": head["warc-block-digest"], "payload": head["warc-payload-digest"]}
        found = {"block": block_digest, "payload": payload_digest}
        for kind in ("block",) if revisit else ("block", "payload"):
            if stated[kind] != "sha1:" + base64.b32encode(found[kind].digest()).decode():
                raise ValueError(f"{head['warc-record-id']}: wrong {kind} digest")
        payload = None if revisit else b"".join(chunks)
        if payload is not None and len(payload) != int(http["content-length"]):
            raise ValueError(f"{head['warc-record-id']}: payload length differs from its HTTP header")
        yield {"fields": head, "http": http, "status": http_status, "payload": payload, "payload_bytes": int(http["content-length"])}


def with_references(pages: DataFrame, id_col: str, payload_col: str, least_revisit: int) -> DataFrame:
    """``pages`` with ``__refers_to`` and ``__revisit``.

    Only ids and digests meet by digest; a digest shared by very many pages is
    a skewed equi-join of narrow rows. Payloads move once, by id.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    keyed = pages.select(F.col(id_col).alias("__id"), F.sha1(payload).alias("__digest"), F.octet_length(payload).alias("__n"))
    last = keyed.filter(F.col("__n") >= least_revisit).groupBy("__digest").agg(F.max("__id").alias("__refers_to"), F.count(F.lit(1)).alias("__copies")).filter("__copies > 1").drop("__copies")
    revisits = keyed.filter(F.col("__n") >= least_revisit).join(last, "__digest").filter(F.col("__refers_to").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__refers_to"))).select(F.col("__id").alias("__rid"), F.col("__digest").alias("__rdigest"), "__refers_to").distinct()
    joined = pages.withColumn("__digest", F.sha1(payload)).join(revisits, F.col(id_col).eqNullSafe(F.col("__rid")) & (F.col("__digest") == F.col("__rdigest")), "left")
    return joined.withColumn("__revisit", F.col("__rdigest").isNotNull()).drop("__rid", "__digest", "__rdigest")


def write_warc(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", least_revisit: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``folder``; the manifest has ``file`` and ``records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        count = [0]

        def payload(stream) -> None:
            batch = first
            while batch is not None:
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                    data = (html.as_py() or "").encode("utf-8", "replace")
                    stream.write(record(page_id.as_py(), url.as_py(), data, refers_to.as_py(), revisit.as_py()))
                count[0] += batch.num_rows
                batch = next(batches, None)

        name = publish(folder, f"pages-{TaskContext.get().partitionId():06d}.warc.gz", payload)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array(count, pa.int64())})

    rows = with_references(pages, id_col, payload_col, least_revisit).select(F.col(id_col).cast("long"), F.col(url_col), F.col(payload_col), F.col("__refers_to").cast("long"), "__revisit")
    rows.mapInArrow(write, "file string, records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("file string, records long").parquet(f"{folder}/manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives in the manifest, digests verified: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, root = filesystem(folder)
                with system.open_input_stream(f"{root}/{file}", compression=None) as source:
                    rows, held = [], 0
                    for x in read_records(source):
                        head = x["fields"]
                        rows.append((_page_of(head["warc-record-id"]), x["payload_bytes"], head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], _page_of(head.get("warc-refers-to")), head["warc-target-uri"], x["payload"]))
                        held += len(x["payload"] or b"")
                        if held > 1 << 24:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
