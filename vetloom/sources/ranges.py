"""Files opened by the tasks that need a range of their bytes."""

from __future__ import annotations

from pyarrow import fs

#: Stores that executors open by themselves; other paths go through Spark's readers as whole files.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
#: Bytes of one range: what a task reads in one go.
RANGE = 32 << 20


def can_range(path: str) -> bool:
    scheme, mark, _ = path.partition(":/")
    return not mark or scheme in SCHEMES


def store(location: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    scheme, _, rest = location.partition(":")
    if location.startswith("/"):
        return fs.LocalFileSystem(), location
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(location.replace("s3a://", "s3://", 1))


def open_file(location: str):
    """The file for reading at any place; nothing is read ahead."""
    at, path = store(location)
    return at.open_input_file(path)


def create_file(location: str):
    """A new file for writing; folders above it are made."""
    at, path = store(location)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return at.open_output_stream(path)


def replace_file(old: str, new: str) -> None:
    at, path = store(old)
    at.move(path, store(new)[1])
