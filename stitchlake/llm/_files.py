"""Binary files in the shared folder, from workers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


@contextlib.contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple]:
    """(open stream, URI) of a file of its own for this attempt of a task: a repeated or speculative
    attempt writes another file, and only the files that a committed manifest names are ever read."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    full = f"{path}/{name}-{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(full, compression=None) as f:
        yield f, folder.rstrip("/") + full[len(path) :]


def open_file(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_stream(path, compression=None)


def exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"file ends early: {len(got)} of {n} bytes")
    return got


def open_seekable(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)
