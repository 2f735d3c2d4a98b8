"""Files on any storage that Arrow can open: local and shared folders, HDFS, object stores."""

from __future__ import annotations

import os

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path within it, and what to put before such paths to name them again."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    system, inner = fs.FileSystem.from_uri(path)
    before = path[: path.index("://") + 3]
    if not inner.startswith("/"):
        return system, inner, before
    return system, inner, before + path[len(before) :].split("/", 1)[0]


def read_bytes(path: str) -> bytes:
    """A whole file."""
    system, inner, _ = filesystem(path)
    with system.open_input_stream(inner) as stream:
        return stream.read()


def write_bytes(path: str, content: bytes, attempt: str) -> None:
    """A whole file, put in place at once, so that a lost or repeated task leaves no half of it."""
    system, inner, _ = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{inner}.{attempt}.part") as stream:
        stream.write(content)
    system.move(f"{inner}.{attempt}.part", inner)
