"""Captured responses as a Spark data source: spark.read.format("webloom_capture").load(folder).

A file holds responses as they came over the wire, each behind a line of JSON that says which url was asked
for, when, how many bytes follow, and, where nothing came, why not. A file is a partition. The option `hosts`, names
with commas between them, is the reader's filter: it passes over the bytes of other hosts without reading them.
Filters are not pushed down by Spark itself, as Spark 4.1.2 keeps the reader of a DataFrame's first filtered
query for its later ones, which then lack rows. Writing is there too: a file a task, under its name only when
it is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse, urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "webloom_capture"
SCHEMA = "url string, host string, final_url string, status_code int, server string, content_type string, error string, captured_at timestamp, html string"
SUFFIX = ".capture"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def host_of(url: str) -> str:
    """As functions.urls.host."""
    try:
        return (urlsplit(url).hostname or "").lower() if "://" in url else ""
    except ValueError:
        return ""


def response(status: int, server: str | None, content_type: str | None, body: str, final_url: str | None = None) -> bytes:
    """A response as it comes over the wire. Header values cannot hold line breaks, which become spaces."""
    fields = {"Server": server, "Content-Type": content_type, "Content-Location": final_url}
    head = [f"HTTP/1.1 {status} -", *(f"{k}: {' '.join(v.split())}" for k, v in fields.items() if v)]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body.encode("utf-8", "surrogatepass")


def parsed(raw: bytes) -> dict:
    """Status, headers and body of a response. What has no status line is a body that was answered with nothing."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    status = lines[0].split(" ")[1:2] if lines[0].startswith("HTTP/") else []
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("content-type")
    charset = (kind or "").lower().partition("charset=")[2].strip("\"' ") or "utf-8"
    try:
        html = body.decode(charset, "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    return {"status_code": int(status[0]) if status and status[0].isdigit() else None, "server": fields.get("server"), "content_type": kind, "final_url": fields.get("content-location"), "html": html}


class CaptureFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str, hosts: str | None):
        self.folder, self.hosts = folder, None if hosts is None else set(hosts.lower().split(","))

    def partitions(self) -> list[CaptureFile]:
        store, path = _opened(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [CaptureFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(SUFFIX)]

    def read(self, partition: CaptureFile) -> Iterator[tuple]:
        store, _ = _opened(self.folder)
        with store.open_input_file(partition.path) as f:
            at, size = 0, f.size()
            while at < size:
                f.seek(at)
                line, length = b"", 4096
                while not line.endswith(b"\n"):
                    got = f.read(length)
                    if not got:
                        raise ValueError(f"{partition.path} ends within a response's line")
                    line = (line + got).partition(b"\n")[0] + (b"\n" if b"\n" in got else b"")
                told = json.loads(line)
                begin = at + len(line)
                at = begin + told["length"]
                if at > size:
                    raise ValueError(f"{partition.path} ends within a response")
                host = host_of(told["url"] or "")
                if self.hosts is not None and host not in self.hosts:
                    continue
                f.seek(begin)
                r = parsed(f.read(told["length"])) if told["length"] else dict.fromkeys(("status_code", "server", "content_type", "final_url", "html"))
                when = told["captured_at"]
                when = None if when is None else datetime.fromtimestamp(when, timezone.utc)
                yield told["url"], host, r["final_url"], r["status_code"], r["server"], r["content_type"], told["error"], when, r["html"]


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class CaptureWriter(DataSourceWriter):
    """Rows of (url, status_code, html, ..), columns as in SCHEMA, any of which may be missing but the url."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        store, path = _opened(self.folder)
        name = f"{path}/.{uuid.uuid4().hex}{SUFFIX}.part"
        store.create_dir(path, recursive=True)
        with store.open_output_stream(name, compression=None) as out:
            for row in iterator:
                r = row.asDict()
                raw = b""
                if r.get("status_code") is not None:
                    raw = response(r["status_code"], r.get("server"), r.get("content_type"), r.get("html") or "", r.get("final_url"))
                when = r.get("captured_at")
                if when is not None and when.tzinfo is None:
                    when = when.astimezone()
                told = {"url": r["url"], "captured_at": None if when is None else when.timestamp(), "length": len(raw), "error": r.get("error")}
                out.write(json.dumps(told).encode() + b"\n" + raw)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.folder)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/{name.removeprefix('.').removesuffix('.part')}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], self.options.get("hosts"))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        if overwrite:
            raise ValueError("captures are added to a folder, never replaced")
        return CaptureWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(CaptureSource)
