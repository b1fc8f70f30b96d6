"""Binary files in the shared folder: written under a temporary name and renamed, so a repeated task does no harm."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def put(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file whole or not at all; returns its size."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(part, path)
    return size


def stream(uri: str):
    """The file's bytes as a stream, as they lie there."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def at(uri: str):
    """A seekable reader."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
