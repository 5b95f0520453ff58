"""Byte access for tasks that read or write single files, on any file system pyarrow knows.

Tables go through Spark's own readers and writers. A few layouts are single files with a
fixed byte format (``.npy``, one exported file per row, checksummed downloads); their tasks
open paths with these helpers, so a shared mount, HDFS or an object store all work.
"""

from __future__ import annotations

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a local path or a URI."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:"):]                    # Hadoop writes file:/a/b
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_bytes(path: str, data: bytes) -> int:
    """Write one file whole and return the size that the file system reports."""
    fs, at = resolve(path)
    with fs.open_output_stream(at) as out:
        out.write(data)
    return fs.get_file_info(at).size


def make_dir(path: str) -> None:
    fs, at = resolve(path)
    fs.create_dir(at, recursive=True)


def blocks(path: str, size: int = 1 << 20):
    """The file's bytes in blocks; a file is never held whole."""
    fs, at = resolve(path)
    with fs.open_input_stream(at) as f:
        while data := f.read(size):
            yield data


def read_at(path: str, start: int, size: int) -> bytes:
    fs, at = resolve(path)
    with fs.open_input_file(at) as f:
        return f.read_at(size, start)
