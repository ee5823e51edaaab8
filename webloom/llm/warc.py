"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset index.

A crawler's archive is often one gzip stream over the whole file, which nothing can seek in. The
normaliser inflates such a stream once, in pieces, rewrites every record as a gzip member of its own
and writes a sidecar index of their offsets. The reader seeks to each indexed member. A task handles
one file; files are named by the attempt that wrote them and only those that Spark committed to the
manifest are read, so lost and repeated tasks leave no trace in the result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.llm import files

LEAST = 100
URN = "urn:webloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_types(pages: DataFrame, scratch: Scratch, id_col: str, html_col: str) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to): refers_to is the smallest id of equal payloads of
    at least LEAST bytes, null in the response itself and for smaller payloads."""
    rows = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST)
    twice = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = scratch.write(twice, "twice")
    rows = rows.join(twice, "digest", "left")  # broadcast only if Spark finds it small enough
    return rows.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(id_, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if id_ is None else id_}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a monolithic .warc.gz per partition; (archive) of each, a URI."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None
        for b in batches:
            for id_, url, payload, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                if name is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    context = files.writer(name)
                    out, gz = context.__enter__(), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(record(id_.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())))
        if name is not None:
            out.write(gz.flush())
            context.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string")


def inflated(parts: Iterable[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """Content of a gzip file of one or many members, in pieces of bounded size. A file that ends within a
    member raises, wherever in its content that is; zeros may stand behind a member."""
    z, fed = zlib.decompressobj(31), False  # whether a member has begun
    for part in parts:
        while part := part if fed else part.lstrip(b"\0"):
            got, fed = z.decompress(part, most), True
            if got:
                yield got
            if z.eof:
                part = z.unused_data
                z, fed = zlib.decompressobj(31), False
            else:
                part = z.unconsumed_tail
    while tail := z.decompress(z.unconsumed_tail, most):
        yield tail
    if fed and not z.eof:
        raise ValueError("the archive ends within a gzip member")


def split_records(parts: Iterable[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header with its blank line, pieces of the block) of each record of an inflated stream.

    A header may be of any length. The pieces must be used up before the next record. Input that ends within a record raises."""
    source, have = iter(parts), b""

    def more() -> bool:
        nonlocal have
        got = next(source, None)
        if got is None:
            return False
        have += got
        return True

    def block(size: int) -> Iterator[bytes]:
        nonlocal have
        while size:
            if not have and not more():
                raise ValueError("the archive ends within a record")
            piece, have = have[:size], have[size:]
            size -= len(piece)
            yield piece

    while True:
        have = have.lstrip(b"\r\n")
        while not have:
            if not more():
                return
            have = have.lstrip(b"\r\n")
        while len(have) < 5 and more():
            pass
        if not have.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        looked = 0
        while (end := have.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(have)
            if not more():
                raise ValueError("a record's header does not end")
        head, have = have[: end + 4], have[end + 4 :]
        pieces = block(int(fields(head)["content-length"]))
        yield head, pieces
        for _ in pieces:
            pass


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's or HTTP header, names in lower case."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive as one gzip member a record, beside an index of (offset, length, type,
    record id) lines; (archive, index, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with files.writer(name) as out, files.writer(f"{name}.idx") as index:
                    for head, pieces in split_records(inflated(files.chunks(source))):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        length = out_write(out, gz.compress(head))
                        for piece in pieces:
                            length += out_write(out, gz.compress(piece))
                        length += out_write(out, gz.compress(b"\r\n\r\n")) + out_write(out, gz.flush())
                        f = fields(head)
                        index.write(f"{offset} {length} {f['warc-type']} {f['warc-record-id']}\n".encode())
                        offset, n = offset + length, n + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{name}.idx"]), pa.array([n], pa.int64())], names=["archive", "index", "records"])

    return archives.select("archive").mapInArrow(run, "archive string, index string, records long")


def out_write(out, data: bytes) -> int:
    out.write(data)
    return len(data)


def read_records(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every indexed record.

    A response's figures are taken from its payload, and must agree with its header; a revisit's
    from the headers that stand for the payload it leaves out."""
    number = lambda urn: int(urn.strip("<>").removeprefix(URN)) if urn.strip("<>") != URN else None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def one(data: bytes) -> tuple:
        raw = zlib.decompress(data, 31)
        end = raw.index(b"\r\n\r\n") + 4
        f = fields(raw[:end])
        block = raw[end : end + int(f["content-length"])]
        http_end = block.index(b"\r\n\r\n") + 4
        told = f["warc-payload-digest"].removeprefix("sha256:")
        size = int(fields(block[:http_end])["content-length"])
        if f["warc-type"] == "response":
            payload = block[http_end:]
            if hashlib.sha256(payload).hexdigest() != told or len(payload) != size:
                raise ValueError(f"damaged record {f['warc-record-id']}")
        refers = f.get("warc-refers-to")
        return number(f["warc-record-id"]), size, told, f["warc-type"], number(refers) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                lines = b"".join(files.chunks(index)).decode().splitlines()
                with files.random_access(archive) as f:
                    for line in lines:
                        offset, length = map(int, line.split(" ", 2)[:2])
                        rows.append(one(f.read_at(length, offset)))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return normalised.select("archive", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Writes `pages` to monolithic archives, normalises them and reads them back: a row per page.

    A null html is an empty payload; payloads under LEAST bytes are never revisited. Rows that repeat
    an id with an equal payload are responses, each of them. A null id is written as an empty name
    and read as null; it is a response unless another row has its payload. A null url leaves out the
    target field. A url of any length is written whole; a page is one value of a row, and only its archive
    is read piece by piece. Other columns are ignored. An empty table gives no archive and no row.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    spread = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raw = scratch.write(write_archives(record_types(pages, scratch, id_col, html_col), scratch.path("raw")), "manifest")
    good = scratch.write(normalise(raw.repartition(spread, "archive"), scratch.path("archives")), "normalised")
    scratch.drop("raw")
    return read_records(good.repartition(spread, "archive"))
