"""Binary files in the folder that all executors share, opened through its own URI.

A task writes under a name of its own attempt and reports the name in its result
rows, so files of failed or repeated attempts are never listed and never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def attempt_name(suffix: str) -> str:
    """A file name that no other attempt uses."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(folder: str, name: str):
    """An output stream for a new file."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}", compression=None)


def open_file(folder: str, name: str):
    """A random-access input for a file."""
    store, path = open_store(folder)
    return store.open_input_file(f"{path}/{name}")
