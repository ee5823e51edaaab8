"""Files that Python workers write into and read from the shared folder, by its URI."""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file:, hdfs:, s3: ...) or of a plain absolute path."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writer(uri: str):
    """A stream into a new file; its folder is made if need be."""
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out


def chunks(uri: str, size: int = 1 << 20) -> Iterator[bytes]:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        while got := f.read(size):
            yield got


def random_access(uri: str):
    store, path = opened(uri)
    return store.open_input_file(path)


@contextmanager
def replacing(uri: str):
    """As writer, but the file appears under its name only when it is whole, in place of an older one."""
    part = f"{uri}.part-{uuid.uuid4().hex}"
    with writer(part) as out:
        yield out
    store, path = opened(uri)
    try:
        store.move(opened(part)[1], path)
    except OSError:  # some stores do not replace; what is there has the same content
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(opened(part)[1])


#: Whether a memory map needs no open file besides.
MAPS_ARE_FREE = sys.version_info >= (3, 13)


def bytes_of(uri: str) -> tuple[np.ndarray, int]:
    """The content of a file, and how many bytes of memory it takes: none where its store is mounted, so
    that it can be mapped; else it is read whole."""
    store, path = opened(uri)
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.getsize(path):
            return np.empty(0, np.uint8), 0
        with open(path, "rb") as f:
            more = {"trackfd": False} if MAPS_ARE_FREE else {}
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **more), np.uint8), 0
    with store.open_input_file(path) as f:
        got = np.frombuffer(f.read(), np.uint8)
        return got, got.nbytes
