"""Files in the shared folder, from tasks: any store that pyarrow opens by URI.

A task writes under a name of its own attempt and hands the name on in its
rows, so a repeated or speculative attempt never touches a file that is read.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyarrow import fs


@cache
def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """``(uri, stream)`` of a new file in the folder."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}")


def open_random(uri: str):
    folder, name = uri.rsplit("/", 1)
    store, path = filesystem(folder)
    return store.open_input_file(f"{path}/{name}")


class Counted:
    """A write-only stream that knows its position, for writers that don't seek."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()
